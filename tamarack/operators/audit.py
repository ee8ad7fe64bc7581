"""Duration and category profiles of shards, buckets and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordered import percentiles
from ..plans.staging import with_same


def shard_profile(df: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Rows, known and unknown durations, mean, linear percentiles and shares over 30, 45 and 60 s; no known duration, no row."""
    d = F.when(~F.isnan(duration), F.col(duration))
    rows = df.select(*keys, d.alias("d"))
    places = percentiles(rows, keys, "d", {"p50_sec": 0.5, "p75_sec": 0.75, "p90_sec": 0.9, "p95_sec": 0.95})
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("known"), F.avg("d").alias("mean_sec"),
        *[(F.avg(F.when(F.col("d") > s, 1.0).when(F.col("d").isNotNull(), 0.0)) * 100).alias(f"over_{s}s_pct") for s in (30, 45, 60)],
    )
    joined = with_same(out.where("known > 0"), places, keys)
    return joined.select(
        *keys, "n_rows", "known", (F.col("n_rows") - F.col("known")).alias("unknown"), "mean_sec",
        *[f"p{q}_sec" for q in (50, 75, 90, 95)], *[f"over_{s}s_pct" for s in (30, 45, 60)],
    )


def bucket_profile(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Second level: sums of rows, unweighted means of the shards' figures."""
    return profile.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n_rows").alias("n_rows"), F.sum("known").alias("known"), F.sum("unknown").alias("unknown"),
        *[F.avg(c).alias(c) for c in ("mean_sec", "p90_sec", "over_30s_pct", "over_45s_pct", "over_60s_pct")],
    )


def top_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The ``n`` most frequent values (ties by value), a top-k report."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.orderBy(F.desc("n_rows"), F.asc_nulls_first("value")).limit(n).select(F.lit(column).alias("column"), "value", "n_rows")


def duration_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name speaks of a duration."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if t in numeric and any(w in c.lower() for w in ("dur", "length", "seconds", "secs"))]


def column_hours(df: DataFrame) -> DataFrame:
    """Hours (mean x rows / 3600), mean and extremes of every duration-like column; NaN and infinities aside."""
    out = None
    for c in duration_columns(df):
        v = F.when((F.col(c) > float("-inf")) & (F.col(c) < float("inf")), F.col(c).cast("double"))
        one = df.select(v.alias("v")).agg(
            F.lit(c).alias("column"), F.count("v").alias("known"), (F.avg("v") * F.count(F.lit(1)) / 3600).alias("hours"),
            F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no duration-like column")
    return out


def duration_probe(df: DataFrame, key: str, duration: str) -> DataFrame:
    """Count, mean, median and sum of known durations; shares under 10 s and over 20 s of all rows, unknown ones included."""
    d = F.when(~F.isnan(duration), F.col(duration))
    rows = df.select(key, d.alias("d"))
    medians = percentiles(rows, [key], "d", {"median_sec": 0.5})
    out = rows.groupBy(key).agg(
        F.count("d").alias("known"), F.avg("d").alias("mean_sec"), F.sum("d").alias("total_sec"),
        (F.avg(F.when(F.col("d") < 10, 1.0).otherwise(0.0)) * 100).alias("pct_under_10s"),
        (F.avg(F.when(F.col("d") > 20, 1.0).otherwise(0.0)) * 100).alias("pct_over_20s"),
    )
    return with_same(out, medians, [key])


def best_so_far(df: DataFrame, run: str, step: str, metric: str, patience: int) -> DataFrame:
    """Whether each evaluation improves strictly on all before it, evaluations since the best, and whether to stop.

    ``df`` has one row per evaluation; a run's evaluations are few.
    """
    past = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(metric).over(past)
    rows = df.withColumn("improved", F.coalesce(F.col(metric) < best, F.lit(True)))
    upto = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_island", F.sum(F.col("improved").cast("int")).over(upto))
    since = F.row_number().over(Window.partitionBy(run, "_island").orderBy(step)) - 1
    rows = rows.withColumn("since_best", since.cast("long")).drop("_island")
    return rows.withColumn("stop", F.col("since_best") >= patience)


def moving_mean(df: DataFrame, run: str, step: str, value: str, width: int) -> DataFrame:
    last = Window.partitionBy(run).orderBy(step).rowsBetween(-(width - 1), 0)
    return df.withColumn("moving_mean", F.avg(value).over(last))


def warmup_decay(step, warmup: int, most: int):
    """Linear warm-up to 1, then linear decay to 0."""
    up = step / F.greatest(F.lit(1), F.lit(warmup))
    down = F.greatest(F.lit(0.0), (F.lit(most) - step) / F.greatest(F.lit(1), F.lit(most - warmup)))
    return F.when(step < warmup, up).otherwise(down)
