"""Segmentation of long recordings: proportional slices, windows, word islands, greedy spans, speech occupancy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

# Fixed values of the segmentation rule.
RATE, SEGMENT_SECONDS, MIN_SECONDS, MIN_WORDS, LONGER_THAN, UP_TO, MOST = 16_000, 25.0, 4.0, 3, 30.0, 180.0, 8


def word_slices(words: Column, n: Column, least: int = MIN_WORDS) -> Column:
    """``n`` proportional slices of an array of words; short slices are empty, too few words give none at all."""

    def slices(own: Column) -> Column:
        w, k = own["w"], own["n"]
        size = F.size(w)

        def slice_of(i: Column) -> Column:
            a, b = F.bround(i * size / k, 0).cast("int"), F.bround((i + 1) * size / k, 0).cast("int")
            return F.when(b - a >= least, F.array_join(F.slice(w, a + 1, F.greatest(b - a, F.lit(0))), " ")).otherwise("")

        whole = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), slice_of)
        return F.when((k > 0) & (size >= k * least), whole).otherwise(F.array().cast("array<string>"))

    return tx.let(F.struct(words.alias("w"), n.alias("n")), slices)


def time_windows(samples: Column, n: Column, rate: int = RATE, least: float = MIN_SECONDS) -> Column:
    """``n`` equal windows as (first, last) samples; none if they are shorter than ``least`` seconds."""
    seconds = samples / F.lit(float(rate))

    def window(i: Column) -> Column:
        first = F.bround(i * seconds / n * rate, 0).cast("long")
        last = F.least(samples.cast("long"), F.bround((i + 1) * seconds / n * rate, 0).cast("long"))
        return F.struct(first.alias("first"), last.alias("last"))

    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), window)
    return F.when((n > 0) & (seconds / n >= least), F.filter(made, lambda w: w["last"] > w["first"])).otherwise(
        F.filter(made, lambda w: F.lit(False))
    )


def segment_rows(df: DataFrame, key: str, duration: str, text: str) -> DataFrame:
    """Segments of recordings longer than 30 and up to 180 seconds whose slices and windows agree in number."""
    samples = F.floor(F.col(duration) * RATE)
    rows = df.where((F.col(duration) > LONGER_THAN) & (F.col(duration) <= UP_TO))
    n = F.least(F.ceil(F.col(duration) / SEGMENT_SECONDS), F.lit(MOST)).cast("int")
    made = F.struct(word_slices(tx.words(F.col(text)), n).alias("slices"), time_windows(samples, n).alias("windows"))
    # The rule on their numbers stays beside the explode: as a filter it would be pushed down and work the arrays out twice.
    agree = tx.let(made, lambda m: F.when(F.size(m["slices"]) == F.size(m["windows"]), F.arrays_zip(m["slices"].alias("slices"), m["windows"].alias("windows"))))
    out = rows.select(key, F.posexplode(agree)).toDF(key, "pos", "col").select(
        key, F.col("pos").cast("long").alias("segment"), F.col("col.windows.first").alias("first_sample"),
        F.col("col.windows.last").alias("last_sample"), F.col("col.slices").alias("text"),
    )
    return out.where("text <> ''")


def chunks(values: Column, width: int) -> Column:
    """Consecutive pieces of at most ``width`` elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(width))
    return F.when(F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i, F.lit(width)))).otherwise(F.array(F.slice(values, 1, 0)))


def frame_times(start: Column, duration: Column, count: Column) -> Column:
    """Centres of ``count`` equal frames."""
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: start + (i + 0.5) * duration / count)


def speech_occupancy(samples: Column, frame: int) -> Column:
    """Share of frames at or above min(max(3 x 10th percentile, 2 % of the peak), half the peak) of the RMS values.

    0 without a full frame or with a peak of at most 1e-8. Array functions only,
    so a recording never leaves its row.
    """
    count = F.floor(F.size(samples) / frame).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)

    def rms(i: Column) -> Column:
        part = F.slice(samples, i * frame + 1, F.lit(frame))
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return F.sqrt(total / frame)

    def share(values: Column) -> Column:
        at = (count - 1) * 0.1
        low = F.floor(at).cast("int")

        def under(part: Column) -> Column:
            first = F.get(part["ordered"], low)
            tenth = first + (F.get(part["ordered"], F.least(low + 1, count - 1)) - first) * (at - low)
            limit = F.least(F.greatest(tenth * 3, part["peak"] * 0.02), part["peak"] * 0.5)
            found = tx.let(limit, lambda least: F.size(F.filter(values, lambda v: v >= least)) / count)
            return F.when(part["peak"] > 1e-8, found).otherwise(F.lit(0.0))

        return tx.let(F.struct(F.array_sort(values).alias("ordered"), F.array_max(values).alias("peak")), under)

    return F.when(count >= 1, tx.let(F.transform(starts, rms), share)).otherwise(F.lit(0.0))


def word_islands(tokens: DataFrame, utterance: str, place: str, delimiter: Column, carry: list[str]) -> DataFrame:
    """``word_no`` for each token between delimiters: the islands left by running counts of delimiters."""
    upto = Window.partitionBy(utterance).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tokens.withColumn("_d", delimiter).withColumn("_gap", F.sum(F.col("_d").cast("int")).over(upto)).where("NOT _d")
    first = Window.partitionBy(utterance).orderBy("_gap")
    return rows.withColumn("word_no", (F.dense_rank().over(first) - 1).cast("long")).select(utterance, place, *carry, "word_no")


def aligned_words(tokens: DataFrame, utterance: str, place: str, delimiter: Column) -> DataFrame:
    """Start frame, last frame and mean posterior of each word from its tokens (start_frame, end_frame, posterior)."""
    rows = word_islands(tokens, utterance, place, delimiter, ["start_frame", "end_frame", "posterior"])
    return rows.groupBy(utterance, "word_no").agg(
        F.min_by("start_frame", place).alias("start_frame"), (F.max_by("end_frame", place) - 1).alias("last_frame"),
        F.avg("posterior").alias("posterior"),
    )


def _spans(utterance: str, longest: float, shortest: float, padding: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, number, open_ = object(), 0, None  # the segment that grows: first start, last end, words, posteriors, duration

        def closed() -> tuple | None:
            first, last, texts, total, length = open_
            start, end = max(0.0, first - padding), last + padding if length is None else min(length, last + padding)
            return (owner, number, start, end, " ".join(texts), total / len(texts), len(texts)) if shortest <= end - start <= longest else None

        for batch in batches:
            rows = []
            for key, start, end, text, posterior, length in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != owner or end - open_[0] > longest:
                    if open_ and (row := closed()):
                        rows.append(row)
                    number = number + 1 if key == owner else 0
                    owner, open_ = key, [start, end, [text], posterior, length]
                else:
                    open_[1] = end
                    open_[2].append(text)
                    open_[3] += posterior
            yield _spanned(rows, batch.schema.field(0).type, utterance)
        if open_ and (row := closed()):
            yield _spanned([row], batch.schema.field(0).type, utterance)

    return run


def _spanned(rows: list[tuple], kind: pa.DataType, utterance: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    types = [kind, pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.int64()]
    names = [utterance, "segment", "start", "end", "text", "posterior", "n_words"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def padded_segments(words: DataFrame, utterance: str, place: str, duration: Column, shortest: float, longest: float, padding: float) -> DataFrame:
    """Segments of consecutive words that each span at most ``longest``, padded within the recording; those outside the limits after padding vanish.

    ``words`` has a row for each word: ``utterance``, ``place`` (its order), start, end, text, posterior. A new segment begins where a word's end
    lies more than ``longest`` after the segment's first start; each boundary depends on the one before, so a recording's words
    are passed in order through one task, which holds one segment at a time. Words with a null utterance, start or end are left out; a null
    text or posterior counts as empty or 0; without a duration a segment may end after the recording.
    """
    own = words.where(F.col(utterance).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    own = own.select(
        utterance, F.col("start").cast("double"), F.col("end").cast("double"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("posterior").cast("double"), F.lit(0.0)).alias("posterior"), duration.cast("double").alias("_d"), F.col(place).alias("_place"),
    )
    rows = own.repartition(utterance).sortWithinPartitions(utterance, "_place").drop("_place")
    kind = words.schema[utterance].dataType.simpleString()
    schema = f"{utterance} {kind}, segment long, start double, end double, text string, posterior double, n_words long"
    return rows.mapInArrow(_spans(utterance, longest, shortest, padding), schema)
