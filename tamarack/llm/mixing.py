"""Mixing sources to target weights along a curriculum.

Each source has a target share of the total size and a weight schedule over the
curriculum. A source's schedule is integrated to its cumulative demand; every
delivery of a record stands at an offset of the source's own stream, and the
inverted demand at that offset is the record's training position. The deliveries
are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import label, usable_seconds
from ..plans.staging import broadcast_if_small, stage
from .sampling import draw

#: Records per bucket of the two-level running sum.
BUCKET_ROWS = 50_000


def source_plan(supply: DataFrame, targets: DataFrame, keys: list[str], ramp: float = 0.5) -> DataFrame:
    """One row per target source: supply, demand, use and its weight schedule.

    ``total`` is the size of the whole supply, targets or not. A source that must
    repeat itself ramps up linearly over the curriculum (``start`` to 2 - start,
    mean 1); the others ramp down so that the weights add up at any time.
    """
    total = supply.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("total"))
    aims = targets.groupBy(*keys).agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).cast("long").alias("max_repeats"),
    )
    plan = aims.crossJoin(F.broadcast(total)).join(supply, keys, "left")  # one row on the right
    plan = plan.withColumn("supply", F.coalesce("size", F.lit(0.0))).withColumn("records", F.coalesce("records", F.lit(0)))
    plan = plan.withColumn("demand", F.col("target_share") * F.col("total"))
    plan = plan.withColumn("used", F.least(F.col("demand"), F.col("supply") * F.col("max_repeats")))
    scarce = F.col("supply") < F.col("demand")
    everyone = Window.partitionBy()
    late = F.sum(F.when(scarce, F.col("used")).otherwise(0.0)).over(everyone)
    rest = F.sum(F.when(scarce, 0.0).otherwise(F.col("used"))).over(everyone)
    slope = F.when(rest > 0, F.least(F.lit(ramp), ramp * rest / F.greatest(late, F.lit(1e-9)))).otherwise(0.0)
    start = F.when(scarce, 1 - slope).otherwise(1 + slope * late / F.greatest(rest, F.lit(1e-9)))
    return plan.withColumn("start", start).drop("size")


def position_of(share: Column, start: Column) -> Column:
    """When a source has given ``share`` of its demand, under weights running linearly from start to 2 - start.

    The integral start*t + (1 - start)*t*t is inverted in the form that stays exact as start nears 1.
    """
    root = F.sqrt(F.greatest(start * start + 4 * (1 - start) * share, F.lit(0.0)))
    return F.least(2 * share / F.greatest(start + root, F.lit(1e-12)), F.lit(1.0))


def running_size(df: DataFrame, keys: list[str], order: str, tie: str, size: str) -> DataFrame:
    """``offset``: the size of the same source's records before this one in a hashed order.

    Two levels, so that a source that holds a third of all rows is spread over
    tasks: sums per bucket of the order, a running sum over the buckets, then one
    inside each bucket. Needs ``records``, the source's number of rows.
    """
    buckets = F.greatest(F.ceil(F.col("records") / F.lit(BUCKET_ROWS)), F.lit(1))
    df = df.withColumn("_bucket", F.floor(F.col(order) * buckets).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(size).alias("_sum"))
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0.0)))
    return df.join(broadcast_if_small(sums), [*keys, "_bucket"]).withColumn("offset", F.col("_base") + F.col("_inside"))


def mix(rows: DataFrame, key: str, keys: list[str], size: str, plan: DataFrame, seed: int = 11) -> DataFrame:
    """Every delivery of every used record with its training ``position`` in [0, 1], not sorted yet.

    A record is delivered in pass r while r x supply + offset is below what the
    source uses, hence at most ``max_repeats`` times. Records without usable size
    and sources without target take no part; an empty table gives an empty mix;
    ``key`` must be unique.
    """
    bare = rows.select(F.col(key).alias("_key"), *keys, F.col(size).alias("_size"))
    bare = bare.join(broadcast_if_small(plan.where("used > 0")), keys).withColumn("_order", draw(F.col("_key"), seed))
    bare = running_size(bare, keys, "_order", "_key", "_size")
    passes = F.ceil((F.col("used") - F.col("offset")) / F.col("supply")).cast("int")
    passes = F.least(passes, F.col("max_repeats").cast("int"))
    out = bare.where(F.col("offset") < F.col("used")).withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    share = ((F.col("pass") - 1) * F.col("supply") + F.col("offset")) / F.col("used")
    return out.select(
        F.col("_key").alias(key), *keys, F.col("_size").alias(size), "pass", position_of(share, F.col("start")).alias("position")
    )


def clip_sources(manifest: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["dataset", "language"]
    rows = manifest.select(
        "row_id", label("dataset").alias("dataset"), label("language").alias("language"), usable_seconds("duration").alias("seconds")
    ).where("seconds IS NOT NULL")
    supply = rows.groupBy(*keys).agg(F.sum("seconds").alias("size"), F.count(F.lit(1)).alias("records"))
    targets = targets.select(label("dataset").alias("dataset"), label("language").alias("language"), "target_share", "max_repeats")
    return rows, stage(source_plan(supply, targets, keys), "sources")


def clip_mix(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix in training order: a range sort by position."""
    rows, plan = clip_sources(manifest, targets)
    return mix(rows, "row_id", ["dataset", "language"], "seconds", plan).orderBy("position", "row_id", "pass")


def mix_report(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and really reached shares of each source, from the mix itself.

    A source is ``short`` if all its deliveries give less than its demand; one
    that is not overshoots by less than its last record.
    """
    keys = ["dataset", "language"]
    rows, plan = clip_sources(manifest, targets)
    got = mix(rows, "row_id", keys, "seconds", plan).groupBy(*keys).agg(
        F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("deliveries"), F.max("pass").alias("repeats")
    )
    out = plan.join(got, keys, "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    whole = F.sum("seconds").over(Window.partitionBy())
    return out.select(
        *keys, "target_share", "max_repeats", "supply", "demand", "seconds",
        F.coalesce("deliveries", F.lit(0)).alias("deliveries"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        (F.col("seconds") / F.col("total")).alias("share_of_demanded"), F.try_divide("seconds", whole).alias("actual_share"),
        (F.col("seconds") < F.col("demand") * (1 - 1e-9)).alias("short"),
    )


def unmet_sources(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that can't give their share even with all repeats."""
    return mix_report(manifest, targets).where("short").select("dataset", "language")
