"""Visually identical texts with different characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import label
from ..plans.staging import broadcast_if_small, stage
from .letters import consistent, consistent_form, has_letters, per_distinct, visible_form
from .pairs import crossed, key_blocks


@F.pandas_udf(T.StringType())
def lettered_form(text: pd.Series) -> pd.Series:
    """Consistent form of each text that has letters, worked out once per distinct value; null for others."""
    return per_distinct(lambda t: consistent(t) if has_letters(t) else None, text)


def clip_forms(manifest: DataFrame) -> DataFrame:
    """``row_id`` and the one consistent form by which transcriptions compare as equal (null for null)."""
    return manifest.select("row_id", consistent_form("transcription").alias("form"))


def same_look_pairs(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """Pairs ``row_a`` < ``row_b`` of one group whose texts differ as strings but look the same.

    Texts meet by their consistent form (compatibility-composed, case-folded,
    blanks mapped, ignorables removed). Only forms with more than one string
    go on; of these the visible form is worked out, and strings are paired if it is
    equal too. Only distinct strings are paired, then joined to blocks of their rows, so
    many rows with one and the same string are never paired with each other.
    Null texts and keys and texts without letters are no case.
    """
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(text).alias("text")).where("text IS NOT NULL AND key IS NOT NULL")
    rows = rows.withColumn("form", lettered_form("text")).where("form IS NOT NULL")
    rows = stage(rows.select("key", "text", F.xxhash64("grp", "form").alias("form"), F.xxhash64("text").alias("string")), "forms")
    several = rows.groupBy("form").agg(F.min("string").alias("s"), F.max("string").alias("t")).where("s <> t").select("form")
    met = rows.join(broadcast_if_small(several), "form", "left_semi")
    met = stage(met.select("form", F.xxhash64(visible_form("text")).alias("seen"), "string", "key"), "candidates")
    strings = met.groupBy("form", "seen", "string").agg(F.count(F.lit(1)).alias("n"))
    a = strings.select("form", "seen", F.col("string").alias("a"))
    b = strings.select("form", "seen", F.col("string").alias("b"))
    pairs = stage(a.join(b, ["form", "seen"]).where("a < b"), "pairs")
    blocks = key_blocks(met, ["form", "seen", "string"], "key", "keys")
    named = pairs.select("form", "seen", F.explode(F.array("a", "b")).alias("string")).distinct()
    blocks = stage(blocks.join(broadcast_if_small(named), ["form", "seen", "string"], "left_semi"), "blocks")
    left = blocks.select("form", "seen", F.col("string").alias("a"), F.col("keys").alias("xs"))
    right = blocks.select("form", "seen", F.col("string").alias("b"), F.col("keys").alias("ys"))
    return crossed(pairs.join(left, ["form", "seen", "a"]).join(right, ["form", "seen", "b"]).select("xs", "ys"))


def clip_lookalikes(manifest: DataFrame) -> DataFrame:
    rows = manifest.select("row_id", label("language").alias("language"), "transcription")
    return same_look_pairs(rows, "row_id", "language", "transcription")
