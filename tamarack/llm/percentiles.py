"""Percentiles of very large numeric columns by exact bisection over rows or combinable pieces.

For each group and target rank an interval of values is kept. Every pass counts the
rows in equal cells of the interval (several halvings at once), and
the cell that holds the rank becomes the next interval, cut back to the values
that occur in it. It ends when every interval is a single value. Counts are combined
on the map side, so a pass shuffles cells, never rows.

A *piece* (a day, a shard, one delivery) keeps, per group, how often each value
occurs, with a bounded relative error if it is to stay small. Pieces are merged by a union, so results of separate
days combine without going back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import label, usable_seconds
from ..plans.staging import BROADCAST_ROWS, fresh, stage
from .grouping import file_name_key

PROBABILITIES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Intervals up to which a pass broadcasts them (about 300 bytes each), and the parts of each group that join them beyond.
#: Joins of more are hinted to be by shuffles: the planner goes by the size of a stage's compressed files, which is far below what a broadcast takes.
SPANS, PARTS = 100_000, 64


def ordinal(value: Column, mantissa_bits: int = 52) -> Column:
    """A long that orders as the double does: its exponent and mantissa.

    Fewer mantissa bits give fewer distinct ordinals, so smaller pieces, at a
    relative error of at most 2**-mantissa_bits. Subnormal numbers order too.
    """
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-1022))
    scaled = size / F.pow(F.lit(2.0), guess)
    exponent = F.when(scaled >= 2, guess + 1).when((scaled < 1) & (guess > -1022), guess - 1).otherwise(guess)
    mantissa = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)
    bits = ((exponent + 1023) * F.lit(1 << 52) + mantissa.cast("long")).cast("long")
    if mantissa_bits < 52:
        step = 1 << (52 - mantissa_bits)
        bits = bits - F.pmod(bits, F.lit(step))
    return F.when(size == 0, F.lit(0).cast("long")).when(value < 0, -bits).otherwise(bits)


def from_ordinal(bits: Column) -> Column:
    size = F.abs(bits)
    exponent = F.shiftright(size, 52)
    fraction = F.pmod(size, F.lit(1 << 52)).cast("double") / F.lit(2.0**52)
    value = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise(
        (fraction + 1) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    )
    return F.when(bits < 0, -value).otherwise(value)


def value_rows(df: DataFrame, groups: dict[str, Column], value: Column, mantissa_bits: int = 52) -> DataFrame:
    """Each counted row as ``groups``, ``ordinal`` and ``n`` = 1; null, NaN and infinite values do not count. Nothing is shuffled."""
    finite = F.when((value > float("-inf")) & (value < float("inf")), value)
    rows = df.select(*[c.alias(g) for g, c in groups.items()], finite.alias("value")).where("value IS NOT NULL")
    return rows.select(*groups, ordinal(F.col("value"), mantissa_bits).alias("ordinal"), F.lit(1).cast("long").alias("n"))


def piece_profile(
    df: DataFrame, groups: dict[str, Column], piece: Column, value: Column, mantissa_bits: int = 52
) -> DataFrame:
    """How often each value occurs per group and piece: columns of ``groups``, ``piece``, ``ordinal``, ``n``.

    One shuffle, combined on the map side. With fewer ``mantissa_bits`` a piece holds at most 2**bits values for
    each power of two, whatever its rows, at a relative error of at most 2**-bits.
    """
    rows = value_rows(df, {**groups, "piece": piece}, value, mantissa_bits)
    return rows.groupBy(*groups, "piece", "ordinal").agg(F.sum("n").alias("n"))


def _same(left: DataFrame, right: DataFrame, names) -> Column:
    cond = F.lit(True)
    for g in names:
        cond = cond & left[g].eqNullSafe(right[g])
    return cond


def percentiles(
    pieces: DataFrame, groups: list[str], probabilities=PROBABILITIES, halvings: int = 8
) -> DataFrame:
    """Percentiles per group from the union of any number of pieces, or from rows (``value_rows``).

    Linear interpolation between the two neighbouring ranks, as usual for
    percentiles of a sample. Returns ``groups``, ``percentile``, ``n`` (rows
    counted) and ``value``. A null group value is a group of its own; a group
    without a usable value gives no row; an empty input gives an empty table;
    ties and repeated rows count as often as they occur. Extra columns of
    ``pieces`` are not read.
    """
    rank, lo, hi, below, cell, at, found = (fresh(x, groups) for x in ("rank", "lo", "hi", "below", "cell", "at", "found"))
    counts = stage(pieces.select(*groups, "ordinal", "n"), "values")
    totals = stage(
        counts.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("ordinal").alias(lo), F.max("ordinal").alias(hi)),
        "totals",
    )
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in probabilities]
    lows = [F.floor(x) for x in places]
    highs = [F.least(x + 1, F.col("n") - 1) for x in lows]
    ranks = F.explode(F.array_distinct(F.array(*lows, *highs)))
    state = totals.select(*groups, "n", ranks.alias(rank), lo, hi, F.lit(0).cast("long").alias(below))
    state = stage(state, "intervals")
    while not state.where(F.col(hi) > F.col(lo)).isEmpty():
        spans = state.where(F.col(hi) > F.col(lo)).select(*groups, lo, hi).distinct()
        own, extra = counts, F.lit(True)
        held = spans.limit(SPANS + 1).count()
        if held <= SPANS:
            spans = F.broadcast(spans)
        else:  # in parts, as one group may hold most rows
            part = fresh("part", groups)
            own = counts.withColumn(part, F.pmod(F.xxhash64("ordinal"), F.lit(PARTS)))
            spans = spans.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).hint("merge")
            extra = own[part] == spans[part]
        near = F.col(hi).cast("double") - F.col(lo).cast("double") < F.lit(2.0**52)
        width = F.when(near, F.expr(f"({hi} - {lo}) div {1 << halvings} + 1").cast("double")).otherwise(
            (F.col(hi).cast("double") - F.col(lo).cast("double")) / F.lit(float((1 << halvings) - 1))
        )
        offset = F.when(near, (F.col("ordinal") - F.col(lo)).cast("double")).otherwise(
            F.col("ordinal").cast("double") - F.col(lo).cast("double")
        )
        hits = own.join(
            spans, _same(own, spans, groups) & extra & (own["ordinal"] >= spans[lo]) & (own["ordinal"] <= spans[hi])
        ).select(*[spans[g] for g in groups], lo, "ordinal", "n", F.floor(offset / width).alias(cell))
        cells = hits.groupBy(*groups, lo, cell).agg(
            F.sum("n").alias("in_cell"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")
        )
        upto = Window.partitionBy(*groups, lo).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.sum("in_cell").over(upto))
        open_ = state.where(F.col(hi) > F.col(lo))
        few = held <= min(SPANS, BROADCAST_ROWS // (2 * len(probabilities)))  # so many ranks an interval has at most
        open_ = F.broadcast(open_) if few else open_.hint("merge")
        after = F.col(below) + F.col("upto")
        narrowed = open_.join(
            cells,
            _same(open_, cells, [*groups, lo])
            & (open_[rank] < open_[below] + cells["upto"])
            & (open_[rank] >= open_[below] + cells["upto"] - cells["in_cell"]),
        ).select(
            *[open_[g] for g in groups],
            "n",
            rank,
            F.col("first").alias(lo),
            F.col("last").alias(hi),
            (after - F.col("in_cell")).alias(below),
        )
        state = stage(state.where(F.col(hi) <= F.col(lo)).unionByName(narrowed), "intervals")
    # Both neighbours of every percentile are picked out of a group's ranks by one aggregation; nothing is joined.
    state = state.withColumn(at, from_ordinal(F.col(lo)))
    picked = [
        F.struct(
            F.lit(float(p)).alias("percentile"),
            (place - low).alias("share"),
            *[F.max(F.when(F.col(rank) == want, F.col(at))).alias(side) for side, want in (("low", low), ("high", high))],
        )
        for p, place, low, high in zip(probabilities, places, lows, highs, strict=True)
    ]
    out = state.groupBy(*groups, "n").agg(F.array(*picked).alias(found)).withColumn(found, F.explode(found))
    low, high, share = (F.col(f"{found}.{x}") for x in ("low", "high", "share"))
    return out.select(*groups, f"{found}.percentile", "n", (low + (high - low) * share).alias("value"))


def clip_pieces(manifest: DataFrame, mantissa_bits: int = 52) -> DataFrame:
    """Day pieces of clip durations per language and subtype."""
    return piece_profile(
        manifest,
        {"language": label("language"), "subtype": label("subtype")},
        F.to_date("ingested_at"),
        usable_seconds("duration"),
        mantissa_bits,
    )


def piece_percentiles(manifest: DataFrame) -> DataFrame:
    """Percentiles of every shard piece and, with a null ``piece``, of the pieces combined.

    Both come from one set of pieces in one bisection. Paths that lead to one file are one
    piece; rows without a shard form the piece ``unknown``.
    """
    groups = ["language", "subtype", "piece"]
    pieces = stage(
        piece_profile(
            manifest,
            {"language": label("language"), "subtype": label("subtype")},
            F.coalesce(file_name_key(F.col("source_shard")), F.lit("unknown")),
            usable_seconds("duration"),
        ),
        "pieces",
    )
    both = pieces.unionByName(pieces.withColumn("piece", F.lit(None).cast("string")))
    return percentiles(both, groups).withColumn("value", F.round("value", 6))


def clip_percentiles(manifest: DataFrame) -> DataFrame:
    """Exact percentiles, by bisection over the rows themselves."""
    rows = value_rows(manifest, {"language": label("language"), "subtype": label("subtype")}, usable_seconds("duration"))
    return percentiles(rows, ["language", "subtype"]).withColumn("value", F.round("value", 6))


def combined_percentiles(manifest: DataFrame, mantissa_bits: int = 10) -> DataFrame:
    """Percentiles from day pieces that were written at a relative error of at most 2**-``mantissa_bits`` and read again."""
    written = stage(clip_pieces(manifest, mantissa_bits), "day_pieces")
    out = percentiles(written, ["language", "subtype"])
    return out.withColumn("value", F.round(F.col("value") + 3e-8, 6))  # values of few bits often lie on a half, which then goes up whatever the last bit
