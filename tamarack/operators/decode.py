"""Decoding emissions and assembling chunk texts: greedy CTC, ordered concatenation, failure isolation, model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def log_softmax(scores: Column) -> Column:
    """Log-probabilities of an array of scores, shifted by the maximum first."""
    wide = F.transform(scores, lambda x: x.cast("double"))

    def shifted(parts: Column) -> Column:
        total = F.aggregate(parts["v"], F.lit(0.0), lambda a, x: a + F.exp(x - parts["top"]))
        return tx.let(parts["top"] + F.ln(total), lambda norm: F.transform(parts["v"], lambda x: x - norm))

    return tx.let(F.struct(wide.alias("v"), F.array_max(wide).alias("top")), shifted)


def greedy_ctc(df: DataFrame, utterance: str, frame: str, scores: str, blank: int = 0) -> DataFrame:
    """Best symbol per frame (the first of equal scores), repeats collapsed, blanks dropped, in frame order."""
    best = F.array_position(F.col(scores), F.array_max(scores)) - 1
    frames = df.select(utterance, F.struct(F.col(frame).alias("f"), best.alias("s")).alias("x"))
    path = frames.groupBy(utterance).agg(F.array_sort(F.collect_list("x")).alias("path"))
    ids = F.transform("path", lambda x: x["s"])
    kept = F.filter(F.transform("path", lambda x, i: F.when((x["s"] != blank) & ((i == 0) | (x["s"] != F.get(ids, i - 1))), x["s"])), lambda s: s.isNotNull())
    return path.select(utterance, kept.alias("symbols"))


def joined_chunks(df: DataFrame, owner: str, place: str, text: str) -> DataFrame:
    """Chunk texts of each owner in order, each normalised and the whole again; empty ones leave no blank.

    The result is one row for each owner, so an owner's whole text has to fit a row.
    """
    own = df.select(owner, F.struct(F.col(place).alias("p"), tx.normalize_text(F.col(text)).alias("t")).alias("x"))
    whole = own.groupBy(owner).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select(owner, tx.squeeze(F.array_join(F.transform("x", lambda c: c["t"]), " ")).alias("text"))


def ordered(report: DataFrame, order: list[Column], place: str) -> DataFrame:
    """A report of few rows in its final order, with each row's place."""
    return report.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy(place)


def isolate_failures(texts: DataFrame, failed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Results without the owners of any failed chunk, and all failures, empty results among them."""
    ok = texts.join(failed.select(key).distinct(), key, "left_anti")
    empty = ok.where(F.coalesce(F.col("text"), F.lit("")) == "").select(key, F.lit("empty result").alias("reason"))
    return ok.where("text <> ''"), failed.select(key, "reason").unionByName(empty)


def infer(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], key: str, policy: str = "strict", batch_rows: int = 32) -> DataFrame:
    """Texts of a pluggable batch function, with an explicit rule for failures.

    ``strict``: a failing batch is retried row by row and failing rows get a
    ``reason`` and no text. ``fallback``: they get the text ``.`` instead.
    """
    if policy not in ("strict", "fallback"):
        raise ValueError("policy must be strict or fallback")

    def one(part: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            return str(fn(part).iloc[0]), None
        except Exception as e:  # noqa: BLE001 - the policy decides what becomes of it
            return ("." if policy == "fallback" else None), type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows]
                try:
                    made = [(str(t), None) for t in fn(part)]
                except Exception:  # noqa: BLE001 - one by one below
                    made = [one(part.iloc[i : i + 1]) for i in range(len(part))]
                yield pd.DataFrame({key: part[key].to_numpy(), "text": [m[0] for m in made], "reason": [m[1] for m in made]})

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(run, f"{key} {kind}, text string, reason string")
