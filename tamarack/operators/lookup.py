"""Lookups and set operations between manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..functions import text as tx
from ..plans.ordered import rank_in_group


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in ``order``; an aggregate, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return out.select(*keys, "_v.*")


def two_tier(members: DataFrame, texts: DataFrame, member: str, key: str, order: str, value: str) -> DataFrame:
    """Texts of archive members: looked up by file stem first, then by full name; misses are dropped.

    A text row stands under its key's stem and its full key; later rows overwrite
    earlier ones.
    """
    rows = texts.where(F.col(key).isNotNull())
    both = rows.select(tx.stem(F.col(key)).alias("_k"), order, value).unionByName(rows.select(F.col(key).alias("_k"), order, value))
    known = last_wins(both, ["_k"], order).select("_k", F.col(value).alias("_v"))
    by_stem = known.select(F.col("_k").alias("_k1"), F.col("_v").alias("_v1"))
    by_name = known.select(F.col("_k").alias("_k2"), F.col("_v").alias("_v2"))
    out = members.join(by_stem, tx.stem(F.col(member)) == F.col("_k1"), "left").join(by_name, F.col(member) == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).where(F.col(value).isNotNull()).select(*members.columns, value)


def combined(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of manifests whose columns may differ; an id that occurs twice is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if not out.groupBy(key).count().where("count > 1").isEmpty():
        raise ManifestError(f"{key} occurs twice")
    return out


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side they stand on."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only_a = left.join(right, keys, "left_anti").withColumn("side", F.lit("left"))
    return only_a.unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("right")))


def rank_zip(a: DataFrame, b: DataFrame, owner: str, place: str, left: str, right: str) -> DataFrame:
    """Values of two tables of the same owner paired by their rank (from 0) in ``place``, which must be unique in it; the longer side is cut.

    Both sides are ranked in ranges and joined by owner and rank, so an owner of any size is spread over tasks.
    """
    x = rank_in_group(a.where(F.col(owner).isNotNull()).select(owner, place, F.col(left).alias("_v")), [owner], [place], "_r").select(owner, "_r", F.col("_v").alias(left))
    y = rank_in_group(b.where(F.col(owner).isNotNull()).select(owner, place, F.col(right).alias("_v")), [owner], [place], "_r").select(owner, "_r", F.col("_v").alias(right))
    return x.join(y, [owner, "_r"]).select(owner, (F.col("_r") - 1).alias("place"), left, right)


def repository_gaps(files: DataFrame, required: list[str], any_of: list[str]) -> DataFrame:
    """Required names a repository lacks, and whether it has any of the alternatives (``repo``, ``name``)."""
    own = files.groupBy("repo").agg(F.collect_set("name").alias("names"))
    want, some = F.array(*map(F.lit, required)), F.array(*map(F.lit, any_of))
    return own.select("repo", F.array_sort(F.array_except(want, "names")).alias("missing"), F.arrays_overlap("names", some).alias("has_any"))
