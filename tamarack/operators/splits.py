"""Leakage-safe and stratified splits, decided by hashes so that no partitioning or seed state matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import hashed_range, rank_in_group
from ..plans.staging import broadcast_if_small, stage


def group_key(language: Column, speaker: Column, source: Column) -> Column:
    """All recordings of a known speaker stay together; the source stands in where no speaker is known."""
    speaker = F.nullif(speaker, F.lit(""))
    identity = F.coalesce(F.concat(F.lit("speaker:"), speaker), F.concat(F.lit("source:"), F.coalesce(source, F.lit("None"))))
    return F.concat(language, F.lit("\x00"), identity)


def seeded(seed: int | str, col: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\x00"), col), 256)


def ranked_groups(groups: DataFrame, strata: list[str], group: str, seed: int | str) -> DataFrame:
    """``place`` (1-based, by seeded hash) and ``size`` of each distinct group in its stratum."""
    groups = stage(groups, "groups")
    sizes = stage(groups.groupBy(*strata).agg(F.count(F.lit(1)).alias("size")), "sizes")
    hashed = groups.join(broadcast_if_small(sizes), strata).withColumn("_hash", seeded(seed, F.col(group)))
    return rank_in_group(hashed, strata, ["_hash", group], "place", hashed_range("_hash", "size")).drop("_hash")


def grouped_split(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """``group`` and ``new_split`` for each row: whole groups go to validation, per language.

    The share is rounded half to even, at least one group and never all of them.
    Languages with fewer than two groups are an error, see ``require_groups``.
    """
    rows = df.withColumn("group", group_key(F.col("language"), F.col("speaker_id"), F.col("source_id")))
    groups = ranked_groups(rows.select("language", "group").distinct(), ["language"], "group", seed)
    take = F.least(F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(fraction), 0)), F.col("size") - 1)
    chosen = groups.select("language", "group", F.when(F.col("place") <= take, "validation").otherwise("train").alias("new_split"))
    return rows.join(chosen, ["language", "group"])


def require_groups(df: DataFrame, languages) -> None:
    rows = df.withColumn("group", group_key(F.col("language"), F.col("speaker_id"), F.col("source_id")))
    counts = rows.where(F.col("language").isin(*languages)).groupBy("language").agg(F.countDistinct("group").alias("n")).collect()
    have = {r["language"]: r["n"] for r in counts}  # at most one row per named language
    short = sorted(x for x in languages if have.get(x, 0) < 2)
    if short:
        raise ValueError(f"at least two source groups are required: {', '.join(short)}")


def leaking_groups(df: DataFrame, group: str = "group", split: str = "new_split") -> DataFrame:
    """Groups that stand in more than one split."""
    seen = df.groupBy(group).agg(F.countDistinct(split).alias("splits"))
    return seen.where("splits > 1")


def stratified_split(df: DataFrame, key: str, strata: list[str], fraction: float, seed: str = "strata") -> DataFrame:
    """Rows of each stratum to evaluation: the rounded share, at least one."""
    ranked = ranked_groups(df.select(key, *strata), strata, key, seed)
    take = F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(fraction), 0))
    return ranked.select(key, *strata, F.when(F.col("place") <= take, "eval").otherwise("train").alias("new_split"))


def floor_split(df: DataFrame, key: str, strata: list[str], share: float = 0.95, cap: int | None = None, seed: str = "floor") -> DataFrame:
    """Train gets the floor of its share after an optional cap per stratum; capped rows are left out."""
    ranked = ranked_groups(df.select(key, *strata), strata, key, seed)
    if cap is not None:
        ranked = ranked.where(F.col("place") <= cap).withColumn("size", F.least("size", F.lit(cap)))
    return ranked.select(key, *strata, F.when(F.col("place") <= F.floor(F.col("size") * F.lit(share)), "train").otherwise("eval").alias("new_split"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "language", "subtype").agg(F.count(F.lit(1)).alias("n_rows"))


def split_hours(df: DataFrame) -> DataFrame:
    """Hours of known durations and the number of unknown ones; groups with only unknown durations are left out."""
    known = F.when(~F.isnan("duration"), F.col("duration"))
    out = df.groupBy("split", "language").agg(
        F.sum(known).alias("_s"), F.count_if(known.isNull()).alias("unknown_rows")
    )
    return out.where("_s IS NOT NULL").select("split", "language", F.round(F.col("_s") / 3600, 3).alias("hours"), "unknown_rows")
