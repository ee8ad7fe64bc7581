"""Budgeted, spread and balanced selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordered import rank_in_group, running_before
from ..plans.staging import broadcast_if_small


def seed_rows(df: DataFrame, split: str, longest: float, per_language: int | None = None, key: str = "row_id") -> DataFrame:
    """Rows of a split with a known duration up to ``longest``; optionally the first few per language by key."""
    rows = df.where((F.col("split") == split) & F.col("duration").isNotNull() & (F.col("duration") <= longest))
    if per_language is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("language").orderBy("id", key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= per_language).drop("_r")


def pilot_rows(df: DataFrame, shortest: float, longest: float) -> DataFrame:
    """Unscripted training rows longer than ``shortest`` and up to ``longest``."""
    return df.where((F.col("split") == "train") & (F.col("subtype") == "unscripted") & (F.col("duration") > shortest) & (F.col("duration") <= longest))


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], size: str, budget: float) -> DataFrame:
    """Rows kept while the sum before them is below the budget, so the one that overshoots stays."""
    return running_before(df, keys, order, {"before": F.col(size)}).where(F.col("before") < budget)


def spread_indices(count: Column, wanted: int) -> Column:
    """Evenly spread 0-based indices, rounded half to even and made distinct."""
    k = F.least(F.lit(wanted), count)
    step = (count - 1) / F.greatest(k - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")), lambda i: F.bround(i * step, 0).cast("long")))


def spread_sample(df: DataFrame, keys: list[str], order: str, wanted: int) -> DataFrame:
    """Evenly spread rows of each key in the order of one column."""
    ranked = rank_in_group(df, keys, [order], "_r")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(broadcast_if_small(sizes), keys)
    return ranked.where(F.array_contains(spread_indices(F.col("_n"), wanted), F.col("_r") - 1)).drop("_r", "_n")


def listed_shards(paths: DataFrame, languages, split: str, subtypes) -> DataFrame:
    """Parquet paths of at least four parts as language/split/subtype/..., with their bucket."""
    part = F.split(F.col("path"), "/")
    keep = F.endswith(F.col("path"), F.lit(".parquet")) & (F.size(part) >= 4) & F.get(part, F.lit(0)).isin(*languages)
    keep = keep & (F.get(part, F.lit(1)) == split) & F.get(part, F.lit(2)).isin(*subtypes)
    return paths.where(keep).select(F.get(part, F.lit(0)).alias("language"), F.get(part, F.lit(2)).alias("subtype"), "path")


def balance_weights(df: DataFrame) -> DataFrame:
    """Per language: rows, hours and the weight sqrt(hours) / rows of each of its rows."""
    out = df.groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("duration") / 3600).alias("hours"))
    return out.withColumn("weight", F.sqrt("hours") / F.col("n_rows"))


def weighted_draws(df: DataFrame, weights: DataFrame, key: str, draws: int, seed: int = 3) -> DataFrame:
    """``draws`` rows drawn with replacement in proportion to their language's weight.

    A draw first chooses a language by its share of the total mass, then a rank
    in it; both are hashes of the draw's number, so a repeated task draws the same.
    """
    mass = weights.select("language", "n_rows", (F.col("weight") * F.col("n_rows")).alias("mass"))
    order = Window.orderBy("language").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per language
    total = F.sum("mass").over(Window.partitionBy())
    spans = mass.withColumn("hi", F.sum("mass").over(order) / total)
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("language")), F.lit(0.0)))

    def uniform(salt: int) -> Column:
        digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}-{salt}\x00"), F.col("draw").cast("string")), 256), 1, 12)
        return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**48)

    numbers = df.sparkSession.range(draws).toDF("draw").withColumn("u", uniform(0)).withColumn("v", uniform(1))
    placed = numbers.join(broadcast_if_small(spans), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    placed = placed.select("draw", "language", (F.floor(F.col("v") * F.col("n_rows")) + 1).alias("place"))
    ranked = rank_in_group(df.select("language", key), ["language"], [key], "place")
    return placed.join(ranked, ["language", "place"]).select("draw", "language", key)


def quota_harvest(df: DataFrame, keys: list[str], order: list[str], target: int, factors: int, bonus: Column, bonus_quota: int) -> DataFrame:
    """Ranked quotas per bucket: ``target`` primary rows, ``target`` // ``factors`` repeats for each factor, and
    ``bonus_quota`` of the rows that meet ``bonus``; ``uses`` tells how often a row is taken.

    (``keys``, ``order``) must be unique. Both quotas are plain limits on a rank, which the planner applies in each
    partition first, so a task meets a few rows of each partition only.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    each = target // max(factors, 1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    primary = df.withColumn("_p", rank).where(F.col("_p") <= target)
    primary = primary.withColumn("_uses", F.lit(1).cast("long") + F.lit(factors) * (F.col("_p") <= each).cast("long")).drop("_p")
    extra = df.where(bonus).withColumn("_p", rank).where(F.col("_p") <= bonus_quota).drop("_p").withColumn("_uses", F.lit(1).cast("long"))
    both = primary.unionByName(extra).groupBy(*keys, *order).agg(F.sum("_uses").alias("uses"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_rest"))
    return both.select(*keys, *order, *[F.col(f"_rest.{c}").alias(c) for c in rest], "uses")


def shard_budget(df: DataFrame, keys: list[str], shard: str, valid: Column, target: int) -> DataFrame:
    """Shards in order until the valid rows before them reach the target, with their counts."""
    counts = df.where(F.col(shard).isNotNull()).groupBy(*keys, shard).agg(F.count_if(valid).alias("valid_rows"))
    kept = running_before(counts, keys, [shard], {"before": F.col("valid_rows")})
    return kept.where(F.col("before") < target).select(*keys, shard, "valid_rows")


def choose_for(column: Column, overrides: dict[str, str], default: str) -> Column:
    """The override of a key, else the default."""
    table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default)) if overrides else F.lit(default)


def count_matching(df: DataFrame, equal: dict[str, str], prefix: dict[str, str]) -> DataFrame:
    """Rows that equal the given values and begin with the given prefixes."""
    cond = F.lit(True)
    for c, v in equal.items():
        cond = cond & (F.col(c) == v)
    for c, v in prefix.items():
        cond = cond & F.startswith(F.col(c), F.lit(v))
    return df.where(cond).agg(F.count(F.lit(1)).alias("n_rows"))
