"""Copies hidden by formatting: recursive radix partitioning on canonical bytes, then tries.

1. Every record is brought to canonical bytes (its letters, see ``letters``).
2. Each partition folds its own copies first, so a text that holds a third of
   all rows leaves a partition as one row.
3. The folded rows are partitioned by a prefix of the canonical bytes. Prefixes
   that hold too many rows are split by further bytes, again and again, until
   each bucket fits.
4. A trie per bucket with a counter at each terminal counts the copies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import label
from ..plans.staging import broadcast_if_small, stage
from .letters import letters, letters_of, per_distinct

#: Rows a bucket may hold before it is split by further bytes.
BUCKET_ROWS = 20_000
#: Bytes of the first prefix; every further split doubles it.
FIRST_BYTES = 12
#: Bytes of distinct texts and their keys that a partition folds before it hands them on, and keys in one folded row.
FOLD_BYTES, FOLD_KEYS = 64 << 20, 1 << 16
#: Record keys in one block of a copy class, and copies from which a class's pairs are made by several tasks, one for each so many copies.
BLOCK, SPREAD = 512, 4_096


class Trie:
    """A path-compressed trie over fixed strides of bytes; each terminal holds a counter."""

    STRIDE = 8

    def __init__(self):
        self.root: dict = {}

    def terminal(self, word: bytes) -> list:
        """The mutable counter [rows, smallest key] of ``word``, made where it is new."""
        node, i, s = self.root, 0, self.STRIDE
        while True:
            edge = word[i : i + s]
            child = node.get(edge)
            i += s
            if child is None:
                leaf = node[edge] = (word, [0, None])
                return leaf[1]
            if type(child) is tuple:
                if child[0] == word:
                    return child[1]
                child = node[edge] = {child[0][i : i + s]: child}
            node = child


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    ref, held, full, size = (context.partitionId() if context else 0) << 40, {}, [], 0

    def out():
        nonlocal ref, held, full, size
        rows = [*full, *((w, keys) for w, keys in held.items() if keys)]
        if rows:
            refs = range(ref, ref + len(rows))
            ref += len(rows)
            words, lists = zip(*rows, strict=True)
            columns = [refs, words, [len(k) for k in lists], [min(k) for k in lists], lists]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _FOLDED, strict=True)], names=_FOLDED_NAMES)
        held, full, size = {}, [], 0

    for batch in batches:
        for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = held.get(word)
            if keys is None:
                held[word] = [key]
                size += len(word)
            else:
                keys.append(key)
                if len(keys) >= FOLD_KEYS:
                    full.append((word, keys))
                    held[word] = []
            size += 40  # a key and its place in the list
        if size > FOLD_BYTES:
            yield from out()
    yield from out()


_FOLDED = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
_FOLDED_NAMES = ["ref", "word", "n", "first", "keys"]
_FOLDED_SCHEMA = "ref long, word binary, n long, first long, keys array<long>"


def fold_partitions(df: DataFrame, key: str, word: Column) -> DataFrame:
    """Each partition's distinct words with their record keys, written as a stage."""
    rows = df.select(F.col(key).cast("long").alias("key"), word.cast("binary").alias("word")).where("word IS NOT NULL AND key IS NOT NULL")
    return stage(rows.mapInArrow(_fold, _FOLDED_SCHEMA), "folded")


def radix_buckets(folded: DataFrame, bucket_rows: int = BUCKET_ROWS, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """Adds ``bucket``: the shortest tried prefix of the word's bytes that holds at most ``bucket_rows`` rows.

    A bucket stays larger only if all its words end within the prefix, that is
    if it holds one word, whose rows the first fold has brought down to one per
    partition.
    """
    depth = first_bytes
    rows = folded.withColumn("bucket", F.substring("word", 1, depth))
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("word")).alias("longest"))
        over = sizes.where((F.col("rows") > bucket_rows) & (F.length("bucket") >= depth) & (F.col("longest") > depth))
        over = stage(over.select("bucket", F.lit(True).alias("over")), "oversized")
        if over.isEmpty():
            return rows
        depth *= 2
        rows = rows.join(broadcast_if_small(over), "bucket", "left")
        rows = rows.withColumn("bucket", F.when(F.col("over"), F.substring("word", 1, depth)).otherwise(F.col("bucket"))).drop("over")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded rows sorted by bucket -> ref, class_id, copies, is_first."""
    bucket, trie, held = None, Trie(), []

    def out():
        if held:
            columns = [[r for r, _, _ in held], [c[1] for _, _, c in held], [c[0] for _, _, c in held], [f == c[1] for _, f, c in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTED, strict=True)], names=_COUNTED_NAMES)

    for batch in batches:
        for own, ref, word, n, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own != bucket:
                if len(held) >= 4096:
                    yield from out()
                    held = []
                bucket, trie = own, Trie()
            counter = trie.terminal(word)
            counter[0] += n
            counter[1] = first if counter[1] is None or first < counter[1] else counter[1]
            held.append((ref, first, counter))
    yield from out()


_COUNTED = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
_COUNTED_NAMES = ["ref", "class_id", "copies", "is_first"]


def copy_classes(folded: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``ref``, ``class_id`` (smallest key of the copies), ``copies`` and ``is_first`` of each folded row."""
    rows = radix_buckets(folded.select("ref", "word", "n", "first"), bucket_rows)
    rows = rows.select("bucket", "ref", "word", "n", "first").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_count, "ref long, class_id long, copies long, is_first boolean")


def collapse(df: DataFrame, key: str, word: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One record per set of copies: ``key`` of its first record and ``copies``.

    Rows whose word is null are no record. Ties and repeated rows count as
    copies; an empty table gives none; very long words are compared whole.
    """
    classes = copy_classes(fold_partitions(df, key, word), bucket_rows)
    return classes.where("is_first").select(F.col("class_id").alias(key), "copies")


def members(df: DataFrame, key: str, word: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``key``, ``representative`` (its first copy) and ``copies`` of every record: the classes without their pairs."""
    folded = fold_partitions(df, key, word)
    classes = copy_classes(folded, bucket_rows).select("ref", "class_id", "copies")
    rows = folded.select("ref", F.explode("keys").alias("key")).join(classes, "ref")
    return rows.select("key", F.col("class_id").alias("representative"), "copies")


def class_blocks(df: DataFrame, key: str, word: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of blocks of keys of one class (``left``, ``right``, and ``own`` if they are one block).

    A class of many copies is cut into parts: each of its blocks meets those of one part in a task of its own, so neither the
    meeting nor the expansion of a large class is one task's work.
    """
    folded = fold_partitions(df, key, word)
    classes = copy_classes(folded, bucket_rows).where("copies > 1").select("ref", "class_id", F.ceil(F.col("copies") / SPREAD).cast("int").alias("parts"))
    blocks = folded.select("ref", F.explode(_blocks(F.col("keys"))).alias("keys")).join(classes, "ref")
    blocks = stage(blocks.select("class_id", "parts", F.xxhash64("ref", "keys").alias("block"), "keys"), "members")
    left = blocks.select("class_id", F.pmod(F.col("block"), F.col("parts")).cast("int").alias("part"), F.col("block").alias("a"), F.col("keys").alias("left"))
    right = blocks.select("class_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("block").alias("b"), F.col("keys").alias("right"))
    return left.join(right, ["class_id", "part"]).where("a <= b").select("class_id", "part", (F.col("a") == F.col("b")).alias("own"), "left", "right")


def copy_pairs(df: DataFrame, key: str, word: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every pair of copies as ``key_a`` < ``key_b``."""
    both = class_blocks(df, key, word, bucket_rows)
    pairs = both.select("own", F.explode("left").alias("x"), "right")
    pairs = pairs.select("own", "x", F.explode("right").alias("y")).where("CASE WHEN own THEN x < y ELSE x <> y END")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def _blocks(keys: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(keys), F.lit(BLOCK))
    return F.transform(starts, lambda i: F.slice(keys, i, F.lit(BLOCK)))


def clip_word(language: Column, transcription: Column) -> Column:
    """Canonical bytes of a clip: language and letters; null where there are no letters."""
    own = letters_of(transcription)
    return F.when(F.length(own) > 0, F.concat(language, F.lit("\x00"), own))


def record_word(line: str | None) -> str | None:
    """Canonical form of a JSON object: sorted field names, each with its value's letters.

    Null for lines that are no JSON object or whose values hold no letters at
    all. Numbers are read as they are written; null reads as an empty text.
    """
    if line is None:
        return None
    try:
        record = json.loads(line, parse_float=str, parse_int=str, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    parts = [(k, letters(_text(v))) for k, v in sorted(record.items())]
    return "\x1e".join(f"{k}\x1f{v}" for k, v in parts) if any(v for _, v in parts) else None


def _refuse(constant: str):
    raise ValueError(constant)


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return "" if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def record_word_of(raw: pd.Series) -> pd.Series:
    return per_distinct(record_word, raw)


def clip_copies(manifest: DataFrame) -> DataFrame:
    rows = manifest.select("row_id", label("language").alias("language"), "transcription").where("transcription IS NOT NULL")
    return collapse(rows, "row_id", clip_word(F.col("language"), F.col("transcription")))


def line_copies(raw_lines: DataFrame) -> DataFrame:
    return collapse(raw_lines.select("line_id", "raw"), "line_id", record_word_of("raw"))


def all_copy_pairs(manifest: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """Pairs of copies in both tables: ``origin``, ``key_a``, ``key_b``."""
    rows = manifest.select("row_id", label("language").alias("language"), "transcription").where("transcription IS NOT NULL")
    clips = copy_pairs(rows, "row_id", clip_word(F.col("language"), F.col("transcription")))
    lines = copy_pairs(raw_lines.select("line_id", "raw"), "line_id", record_word_of("raw"))
    return clips.select(F.lit("manifest").alias("origin"), "key_a", "key_b").unionByName(
        lines.select(F.lit("raw_lines").alias("origin"), "key_a", "key_b")
    )


def all_members(manifest: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """Class membership in both tables: ``origin``, ``key``, ``representative``, ``copies``."""
    rows = manifest.select("row_id", label("language").alias("language"), "transcription").where("transcription IS NOT NULL")
    clips = members(rows, "row_id", clip_word(F.col("language"), F.col("transcription")))
    lines = members(raw_lines.select("line_id", "raw"), "line_id", record_word_of("raw"))
    return clips.select(F.lit("manifest").alias("origin"), "*").unionByName(lines.select(F.lit("raw_lines").alias("origin"), "*"))
