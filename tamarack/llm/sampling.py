"""Samples whose category shares follow given targets.

Rows are accepted independently with a probability derived from the ratio of the
category's goal to its observed count, slightly oversampled; the surplus is then
taken away exactly. Each row's draw is a hash of its key, so the sample does not
depend on partitioning and survives a repeated task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import label
from ..plans.staging import BROADCAST_ROWS, broadcast_if_small, fresh, stage


def draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) fixed by the row's key and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(2.0**53)


def goals(observed: DataFrame, targets: DataFrame, categories: list[str], fraction: float) -> DataFrame:
    """One row per target: what it needs and what it can get.

    ``need`` is the larger of ``min_rows`` and target_share x the sample size;
    ``goal`` is the whole number of rows aimed at (largest remainders make the
    shares add up) and ``taken`` the rows available for it. ``observed`` has ``categories``, ``rows`` and is summed over all categories.
    """
    total = observed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_total"))
    bare = targets.groupBy(*categories).agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.max("min_rows"), F.lit(0)).cast("long").alias("min_rows"),
    )
    plan = bare.crossJoin(F.broadcast(total)).join(observed, categories, "left")  # one row on the right
    plan = plan.withColumn("observed", F.coalesce("rows", F.lit(0)).cast("long"))
    ideal = F.col("target_share") * F.lit(float(fraction)) * F.col("_total")
    plan = plan.withColumn("ideal", ideal).withColumn("need", F.greatest(ideal, F.col("min_rows").cast("double")))
    # Largest remainders: the targets are few, so one ordered pass over them is cheap.
    order = Window.orderBy((F.col("ideal") - F.floor("ideal")).desc(), *categories)
    spare = F.sum(F.col("ideal")).over(Window.partitionBy()) - F.sum(F.floor("ideal")).over(Window.partitionBy())
    whole = F.floor("ideal") + (F.row_number().over(order) <= F.round(spare)).cast("long")
    plan = plan.withColumn("goal", F.greatest(whole, F.col("min_rows")))
    plan = plan.withColumn("taken", F.least("goal", "observed"))
    return plan.select(
        *categories, "target_share", "min_rows", "observed", "ideal", "need", "goal", "taken"
    )


def filled(plan: DataFrame, categories: list[str]) -> DataFrame:
    """The plan with the rows that short categories lack given to those that have more, in proportion to their targets.

    The sample then has its full size, or more where minimum rows ask for more. Each gets share x level up to what it has; the level is where the given rows make up the lack. The targets are few, so
    ordered passes over them are cheap. Without enough rows in all, every category gives what it has.
    """
    every = Window.partitionBy()
    share = F.greatest("target_share", F.lit(0.0))
    rows = plan.withColumn("_spare", F.when(share > 0, F.col("observed") - F.col("taken")).otherwise(0)).withColumn("_lack", F.greatest(F.round(F.sum("ideal").over(every)).cast("long") - F.sum("taken").over(every), F.lit(0)))
    order = Window.orderBy(F.when(share > 0, F.col("_spare") / share).otherwise(0.0), *categories)
    before, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(F.col("_lack") - F.coalesce(F.sum("_spare").over(before), F.lit(0)), F.sum(share).over(later))
    # With the first few categories used up, the others would need this level; the true one is the highest of them.
    rows = rows.withColumn("_level", level).withColumn("_level", F.coalesce(F.max("_level").over(every), F.lit(0.0)))
    ideal = F.least(F.col("_spare").cast("double"), F.col("_level") * share)
    rows = rows.withColumn("_ideal", ideal).withColumn("_extra", F.floor("_ideal"))
    room = Window.orderBy(F.when(F.col("_extra") < F.col("_spare"), F.col("_ideal") - F.col("_extra")).otherwise(-1.0).desc(), *categories)
    left = F.least("_lack", F.sum("_spare").over(every)) - F.sum("_extra").over(every)
    rows = rows.withColumn("_extra", F.col("_extra") + ((F.row_number().over(room) <= left) & (F.col("_extra") < F.col("_spare"))).cast("long"))
    return rows.withColumn("taken", F.col("taken") + F.col("_extra")).select(*plan.columns)


def draw_sample(df: DataFrame, key: str, categories: list[str], plan: DataFrame, seed: int = 7, width: float = 6.0) -> DataFrame:
    """Exactly ``taken`` rows of each category of ``plan``, drawn uniformly.

    A row is surely in below the acceptance probability minus a margin, surely
    out above it plus the margin; only the margin (about the square root of the
    category's rows) is ranked, so no category is ever gathered into one task.
    The margin doubles in the rare case that the cut lies outside it. ``key``
    must be unique; ties of the draw go by the key. Null categories match no
    target; an empty table gives an empty sample; other columns pass through.
    """
    u, p, slack = (fresh(x, df.columns) for x in ("draw", "chance", "slack"))
    taken, sure, place = (fresh(x, df.columns) for x in ("taken", "sure", "place"))
    chance = F.col("taken") / F.greatest(F.col("observed"), F.lit(1))
    spread = F.sqrt(chance * (1 - chance) / F.greatest(F.col("observed"), F.lit(1))) + 1 / F.greatest(F.col("observed"), F.lit(1))
    wide = stage(plan.where("taken > 0").select(*categories, F.col("taken").alias(taken), chance.alias(p), spread.alias(slack)), "chances")
    drawn = df.withColumn(u, draw(F.col(key), seed))
    while True:
        bounds = wide.withColumn(slack, F.col(slack) * width)
        joined = drawn.join(broadcast_if_small(bounds), categories)
        joined = joined.where(F.col(u) < F.col(p) + F.col(slack))  # slight oversampling
        in_sure = F.col(u) < F.col(p) - F.col(slack)
        counts = joined.groupBy(*categories).agg(
            F.count_if(in_sure).alias(sure), F.count(F.lit(1)).alias("accepted"), F.max(taken).alias("_goal")
        )
        counts = stage(counts, "accepted")
        if counts.where((F.col(sure) > F.col("_goal")) | (F.col("accepted") < F.col("_goal"))).isEmpty():
            break
        width *= 2
    cut = counts.select(*categories, sure)
    joined = joined.join(broadcast_if_small(cut), categories)
    certain = joined.where(in_sure).select(*df.columns)
    margin = joined.where(~in_sure).withColumn(place, F.row_number().over(Window.partitionBy(*categories).orderBy(u, key)))
    return certain.unionByName(margin.where(F.col(place) <= F.col(taken) - F.col(sure)).select(*df.columns))


def clip_goals(manifest: DataFrame, targets: DataFrame, fraction: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The clips with normalised categories, and the staged plan of their sample."""
    cats = ["language", "subtype"]
    rows = manifest.select("row_id", label("language").alias("language"), label("subtype").alias("subtype"))
    observed = rows.groupBy(*cats).agg(F.count(F.lit(1)).alias("rows"))
    targets = targets.select(label("language").alias("language"), label("subtype").alias("subtype"), "target_share", "min_rows")
    return rows, stage(goals(observed, targets, cats, fraction), "goals")


def clip_sample(manifest: DataFrame, targets: DataFrame, fraction: float = 0.5, fill: bool = False) -> DataFrame:
    """The sample; with ``fill`` the rows that short categories lack come from the others, so that it has its full size."""
    cats = ["language", "subtype"]
    rows, plan = clip_goals(manifest, targets, fraction)
    return draw_sample(rows, "row_id", cats, filled(plan, cats) if fill else plan)


def sample_report(manifest: DataFrame, targets: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Targets beside what the drawn sample really holds, and what it would hold with the lacking rows filled up from other categories.

    A target is ``short`` if the sample used up all rows of its category and still holds fewer than it needs.
    """
    cats = ["language", "subtype"]
    rows, plan = clip_goals(manifest, targets, fraction)
    got = draw_sample(rows, "row_id", cats, plan).groupBy(*cats).agg(F.count(F.lit(1)).alias("sampled"))
    full = filled(plan, cats).select(*cats, F.col("taken").alias("filled"))
    out = plan.join(got, cats, "left").join(full, cats).withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    every = Window.partitionBy()  # a row for each target
    short = (F.col("sampled") == F.col("observed")) & (F.col("sampled") < F.col("need"))
    return out.select(
        *cats, "target_share", "min_rows", "observed", "goal", "sampled", (F.col("goal") - F.col("sampled")).alias("deficit"), short.alias("short"),
        F.try_divide("sampled", F.sum("sampled").over(every)).alias("reached_share"), "filled", F.try_divide("filled", F.sum("filled").over(every)).alias("filled_share"),
    )


def unmet_targets(manifest: DataFrame, targets: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Targets that the drawn sample can't meet."""
    return sample_report(manifest, targets, fraction).where("short").select("language", "subtype")
