"""Word and character error rates: pooled, per language and macro-averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..functions import text as tx
from ..functions.distance import word_edits


def edit_counts(pairs: DataFrame, reference: Column, hypothesis: Column, keep: list[str]) -> DataFrame:
    """Edits and reference units of each pair, both sides normalised alike beforehand."""
    rows = pairs.select(*keep, F.coalesce(reference, F.lit("")).alias("_r"), F.coalesce(hypothesis, F.lit("")).alias("_h"))
    return rows.select(
        *keep, word_edits("_r", "_h").alias("word_edits"), F.size(tx.words(F.col("_r"))).cast("long").alias("ref_words"),
        F.levenshtein("_r", "_h").cast("long").alias("char_edits"), F.length("_r").cast("long").alias("ref_chars"),
    )


def error_rates(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled rates: summed edits over summed reference units, rounded to 4 places."""
    out = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("word_edits", "ref_words", "char_edits", "ref_chars")])
    return out.select(
        *keys, "ref_words", F.round(F.try_divide("word_edits", "ref_words"), 4).alias("wer"),
        F.round(F.try_divide("char_edits", "ref_chars"), 4).alias("cer"),
    )


def rates_with_total(counts: DataFrame, key: str) -> DataFrame:
    """Pooled rate of each key and, in the same pass, of all rows (key ``all``)."""
    out = counts.rollup(key).agg(F.grouping(key).alias("_g"), F.sum("word_edits").alias("e"), F.sum("ref_words").alias("w"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(key)).alias(key), F.round(F.try_divide("e", "w"), 4).alias("wer"))


def macro_rate(counts: DataFrame, key: str, languages) -> DataFrame:
    """Unweighted mean of the languages' pooled rates, beside the number of languages found and wanted."""
    per = counts.where(F.col(key).isin(*languages)).groupBy(key).agg((F.sum("word_edits") / F.sum("ref_words")).alias("wer"))
    return per.agg(F.round(F.avg("wer"), 6).alias("macro_wer"), F.count(F.lit(1)).alias("languages"), F.lit(len(languages)).cast("long").alias("wanted"))


def require_macro_rate(counts: DataFrame, key: str, languages) -> float:
    """The macro rate, an error if a language has no row or no reference word."""
    found = {r[key]: r["w"] for r in counts.where(F.col(key).isin(*languages)).groupBy(key).agg(F.sum("ref_words").alias("w")).collect()}  # one row per language
    missing = [x for x in languages if not found.get(x)]
    if missing:
        raise ManifestError(f"no reference words for {', '.join(missing)}")
    return macro_rate(counts, key, languages).first()["macro_wer"]
