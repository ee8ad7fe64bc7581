"""Ranks, running sums and percentiles over large groups in two levels: over ranges of the order, then inside each range.

No group is gathered into one task: one row per range meets in the window over ranges, and only one range's
rows in the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import broadcast_if_small, fresh, stage, with_same

#: Rows of one stratum in a range of a hashed order.
RANGE_ROWS = 50_000


def in_ranges(df: DataFrame, keys: list[str], order: list[str], part: str) -> DataFrame:
    """``df`` written in ranges of (``keys``, ``order``), with the number of its range in ``part``.

    The ranges come from the data, so a group of any size, and values that share any prefix, are cut into even parts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")


def running_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """A column for each of ``values``: its sum over the rows of the same ``keys`` that come earlier in ``order``.

    Ranges are cut from the data unless a ``bucket`` is given, which must be monotone in ``order`` and of bounded size
    (a part of a hashed order, say). Ties share nothing: make ``order`` unique. Null values count as 0; null keys are a group.
    """
    b = fresh("range", [*df.columns, *values])
    rows = in_ranges(df, keys, order, b) if bucket is None else df.withColumn(b, bucket)
    parts, bases = {}, {}
    for out in values:
        parts[out] = fresh(f"part_{out}", [*df.columns, *values, *parts.values()])
        bases[out] = fresh(f"base_{out}", [*df.columns, *values, *parts.values(), *bases.values()])
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, b).agg(*[F.sum(v).alias(parts[out]) for out, v in values.items()])
    sums = sums.select(*keys, b, *[F.coalesce(F.sum(parts[out]).over(before), F.lit(0)).alias(bases[out]) for out in values])
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(parts[out]) for out, v in values.items()])
    joined = with_same(rows, sums, [*keys, b], "inner")
    return joined.select(*df.columns, *[(F.col(bases[out]) + F.col(parts[out])).alias(out) for out in values])


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None) -> DataFrame:
    """1-based rank of each row inside its ``keys`` by ``order``, without gathering a group into one task."""
    return running_before(df, keys, order, {out: F.lit(1).cast("long")}, bucket).withColumn(out, F.col(out) + 1)


def hashed_range(hashed: str, size: str, rows: int | None = None) -> Column:
    """The range of a hexadecimal hash among as many as its stratum's ``size`` asks for."""
    count = F.ceil(F.col(size) / F.lit(rows or RANGE_ROWS))
    return F.floor(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * count)


def percentiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Percentiles (linear between neighbouring ranks) of each group's known values, a column for each; groups without any give no row.

    Equal values are counted on the map side; the distinct ones are ranked in ranges and only those at a wanted rank are kept.
    """
    n, before, total = (fresh(x, [*df.columns, *probabilities]) for x in ("n", "before", "total"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
    placed = running_before(counts, keys, [value], {before: F.col(n)})
    totals = placed.groupBy(*keys).agg(F.sum(n).alias(total))
    totals = broadcast_if_small(totals)
    rows = with_same(placed, totals, keys, "inner")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col(before) <= rank) & (rank < F.col(before) + F.col(n)), F.col(value)))

    picked = []
    for i, p in enumerate(probabilities.values()):
        low = F.floor((F.col(total) - 1) * F.lit(p))
        picked += [at(low).alias(f"low_{i}"), at(F.least(low + 1, F.col(total) - 1)).alias(f"high_{i}")]
    out = rows.groupBy(*keys).agg(F.max(total).alias(total), *picked)
    made = []
    for i, (name, p) in enumerate(probabilities.items()):
        place = (F.col(total) - 1) * F.lit(p)
        made.append((F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * (place - F.floor(place))).alias(name))
    return out.select(*keys, *made)
