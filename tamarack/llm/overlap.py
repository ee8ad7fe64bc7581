"""Same or near-same records across splits: minwise-hashed shingles in banded buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_distance
from ..functions.labels import label
from ..plans.staging import broadcast_if_small, release, stage
from .letters import letters_of
from .pairs import crossed, key_blocks

#: Kinds of bands: letters of a shingle, letters of the stretches in which it counts as another one (counted from the text's end if
#: below 0, the same anywhere in the text if 0), bands, minhashes in each.
#: Shingles that hold their rough place tell unrelated texts apart with few letters, so many edits may fall between them; places from
#: either end find texts with a part put in front or behind, the first kind those with a part put in elsewhere.
SCHEMES = ((4, 0, 4, 4), (3, 16, 20, 3), (3, -16, 20, 3))
#: Bands whose keys are shuffled at once.
ROUND = 12
#: The bands where shingles alone decide.
PLAIN = ((4, 0, 32, 4),)
#: Letters of a shingle where texts are verified.
SHINGLE = 4
#: A bucket with so many texts in a sample of one text in ``SAMPLED`` is joined in parts; this spreads work and changes no result.
SAMPLED, HOT, PART = 64, 32, 2_000
#: Exact Jaccard similarity of the shingle sets that a candidate needs where no edit rule is given.
JACCARD = 0.3
#: Edits allowed, as a share of the longer text.
EDITS = 0.15
#: Letters up to which candidates are found without loss, by blocks of which an edit rule leaves one whole.
SHORT = 32
EVALUATION = ("validation", "test")

_SEEDS = np.random.default_rng(20240917).integers(1, 2**32, (2, 512), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_hashes(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 32-bit hashes of all shingles of all texts, and where each text's begin.

    A text shorter than a shingle has one shingle, padded with zeros.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    padded = np.maximum(sizes, n)
    codes = np.frombuffer("".join(t if len(t) >= n else t + "\0" * (n - len(t)) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(max(len(codes) - n + 1, 0), np.uint32)
    for i in range(n):
        h = (h ^ codes[i : i + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    ends = np.cumsum(padded)
    keep = np.ones(len(codes), bool)
    for i in range(1, n):
        keep[ends - i] = False
    return h[keep[: len(h)]], np.concatenate([[0], np.cumsum(padded - n + 1)[:-1]]).astype(np.int64)


def letter_counts(texts: list[str]) -> np.ndarray:
    """Two longs per text that hold, in four bits each, how often each of 32 classes of letters occurs, by 16."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cells = np.repeat(np.arange(len(texts)) * 32, sizes) + (codes & np.uint32(31))
    counts = (np.bincount(cells, minlength=32 * len(texts)) & 15).astype(np.uint64).reshape(-1, 2, 16)
    return (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def counts_apart(pairs: list[tuple[str, str]]) -> Column:
    """By how much the counts of the letters of two texts differ at least, in all; ``pairs``: the columns of ``letter_counts`` of either.

    An edit changes this by at most 2. Eight counts at a time, one in a byte; the bytes are summed by a remainder, which can only be too small.
    """
    low, eights = 0x0F0F0F0F0F0F0F0F, 0x0808080808080808
    each = []
    for x, y in pairs:
        for shift in (0, 4):
            own, other = (f"(shiftrightunsigned({c}, {shift}) & {low}L)" for c in (x, y))
            apart = f"(({own} + {low + 0x0101010101010101}L - {other}) & {low}L)"
            back = f"({apart} & {eights}L)"  # from 8 on it is nearer from the other side
            each.append(f"(({apart} ^ (shiftleft({back}, 1) - shiftright({back}, 3))) + shiftright({back}, 3))")
    return F.expr(f"({' + '.join(each)}) % 255L")


def band_keys(texts: list[str], salt: np.ndarray, schemes=PLAIN, only: range | None = None) -> np.ndarray:
    """One 48-bit bucket key per text and band (``only`` of these bands, if given); ``salt`` keeps groups apart.

    Where a shingle's rough place counts, the stretches of each band begin elsewhere, so edits that move letters
    over the border of a stretch do so in few bands.
    """
    total = sum(bands for _, _, bands, _ in schemes)
    if not texts:
        return np.zeros((0, total if only is None else len(only)), np.int64)
    keys = np.zeros((total, len(texts)), np.uint64)
    at = row = 0
    for n, stretch, bands, rows in schemes:
        if only is not None and not set(range(at, at + bands)) & set(only):
            at, row = at + bands, row + bands * rows
            continue
        hashes, starts = shingle_hashes(texts, n)
        counts = np.diff(starts, append=len(hashes))
        place = np.arange(len(hashes)) - np.repeat(starts, counts)
        if stretch < 0:
            place = np.repeat(counts, counts) - 1 - place
        place, width = place.astype(np.uint32), abs(stretch)
        scratch = np.empty_like(hashes)
        for b in range(bands):
            if only is not None and at not in only:
                at, row = at + 1, row + rows
                continue
            own = hashes
            if stretch:
                own = (hashes ^ ((place + np.uint32(b * width // bands)) // np.uint32(width) * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
                own ^= own >> np.uint32(15)
            for _ in range(rows):
                np.bitwise_xor(own, _SEEDS[0, row], out=scratch)
                np.multiply(scratch, _SEEDS[1, row], out=scratch)
                least = np.minimum.reduceat(scratch, starts).astype(np.uint64)
                keys[at] = (keys[at] ^ (least + np.uint64(at + 1))) * np.uint64(0x9E3779B97F4A7C15)
                keys[at] ^= keys[at] >> np.uint64(29)
                row += 1
            at += 1
    if only is not None:
        keys = keys[only.start : only.stop]
    keys ^= salt.astype(np.uint64)[None, :]
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys >>= np.uint64(16)  # fewer bytes to shuffle; texts that meet by chance are told apart when they are verified
    return keys.T.astype(np.int64)


def most_edits(longer: int, edits: float) -> int:
    return int(edits * longer + 1e-9)


def block_keys(text: str, salt: int, edits: float, indexed: bool) -> set[int]:
    """Keys of which two short texts with few enough edits share one; ``indexed`` texts give their blocks, others all that may equal one.

    Of e + 1 blocks e edits leave one whole, moved by at most e places.
    """
    n, keys = len(text), set()
    for own in [n] if indexed else range(1, SHORT + 1):
        if abs(own - n) > most_edits(max(own, n), edits):
            continue
        e = max(most_edits(m, edits) for m in range(1, SHORT + 1) if abs(m - own) <= most_edits(max(m, own), edits))
        for i in range(e + 1):
            x, y = own * i // (e + 1), own * (i + 1) // (e + 1)
            for at in [x] if indexed else range(max(0, x - e), min(n - (y - x), x + e) + 1):
                word = f"{salt} {own} {i} {text[at : at + y - x]}".encode("utf-8", "surrogatepass")
                keys.add(int.from_bytes(blake2b(word, digest_size=6).digest(), "little"))
    return keys


def _band_batches(schemes, edits: float | None, indexed: bool, blocks_too: bool, only: range | None):
    alone = 0 if edits is None else int(SHORT * (1 - edits))  # texts up to here only match texts that the blocks find

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # the working set stays in the processor's cache
                part = batch.slice(at, 1000)
                texts, salt = part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
                length = np.array([len(t) for t in texts])
                each: list = [np.zeros(0, np.int64)] * len(texts)
                long = np.flatnonzero(length > alone)
                for i, keys in zip(long.tolist(), band_keys([texts[i] for i in long], salt[long], schemes, only), strict=True):
                    each[i] = keys
                for i in np.flatnonzero(length <= SHORT).tolist() if edits is not None and blocks_too else ():
                    blocks = block_keys(texts[i], int(salt[i]), edits, indexed)
                    each[i] = np.concatenate([each[i], np.fromiter(blocks, np.int64, len(blocks))])
                offsets = np.cumsum([0, *map(len, each)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(each)))
                s, t = letter_counts(texts).T
                columns = [part.column(0), pa.array(length, pa.int32()), pa.array(s), pa.array(t), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "length", "s", "t", "keys"])

    return run


def _verify(jaccard: float, edits: float | None):
    def shingles(t: str) -> set[str]:
        return {t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} or {t}

    def near(s: str, own: set[str], t: str) -> bool:
        most = most_edits(max(len(s), len(t)), edits)
        least = len(t) - SHINGLE + 1 - SHINGLE * most  # shingles that the edits leave whole
        if least > 0 and sum(t[i : i + SHINGLE] in own for i in range(len(t) - SHINGLE + 1)) < least:
            return False
        return edit_distance(s, t, most) <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep, last, own = [], None, set()
            for i, (s, t) in enumerate(zip(x, y, strict=True)):
                if s != last:
                    last, own = s, shingles(s)
                if edits is not None:
                    keep.append(near(s, own, t))
                    continue
                other = shingles(t)
                both = len(own & other)
                keep.append(both >= jaccard * (len(own) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], names=["a", "b"])

    return run


def bucket_pairs(classes: DataFrame, schemes, edits: float | None, blocks_too: bool = True, only: range | None = None) -> DataFrame:
    """Candidates (``a`` of train, ``b`` held out): all pairs that share a bucket of these bands (or of the short texts' blocks), each once.

    Pairs whose lengths or counts of letters tell that they differ by more than ``edits`` are dropped where they meet, since unrelated
    texts that share a bucket grow faster than the rows.
    A bucket that a sample shows to be hot is cut into parts on both sides, which meet in tasks of their own.
    """
    def banded(side: str, rows: DataFrame) -> DataFrame:
        own = rows.where(side).select("rep", "text", "salt").mapInArrow(
            _band_batches(schemes, edits, side == "train", blocks_too, only), "rep long, length int not null, s long not null, t long not null, keys array<long>"
        )
        return own.select(F.explode("keys").alias("key"), "rep", "length", *(["s", "t"] if edits is not None else []))

    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0)
    hot = None
    for side in ("train", "held"):
        counts = banded(side, sample).groupBy("key").agg((F.ceil(F.count(F.lit(1)) * SAMPLED / PART)).cast("int").alias(f"{side}_parts"), F.count(F.lit(1)).alias("n"))
        counts = counts.where(F.col("n") >= HOT).drop("n")
        hot = counts if hot is None else hot.join(counts, "key", "full")
    hot = stage(hot.select("key", F.coalesce("train_parts", F.lit(1)).alias("p"), F.coalesce("held_parts", F.lit(1)).alias("q")), "hot")
    left, right = banded("train", classes), banded("held", classes)
    on = ["key"]
    if not hot.isEmpty():
        known, on = broadcast_if_small(hot), ["key", "x", "y"]

        def parted(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
            rows = rows.join(known, "key", "left").withColumn(mine, F.coalesce(F.pmod(F.xxhash64("rep"), F.col(own)), F.lit(0)).cast("int"))
            parts = F.when(F.col(other).isNotNull(), F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))
            return rows.withColumn(theirs, F.explode(parts)).drop("p", "q")

        left, right = parted(left, "p", "q", "x", "y"), parted(right, "q", "p", "y", "x")
    left = left.withColumnsRenamed({"rep": "a", "length": "m", "s": "s_a", "t": "t_a"})
    right = right.withColumnsRenamed({"rep": "b", "length": "n", "s": "s_b", "t": "t_b"})
    cand = left.join(right, on).where("a <> b")
    if edits is not None:
        most, longer = F.greatest("m", "n") * F.lit(edits) + F.lit(1e-9), F.abs(F.col("m") - F.col("n"))
        cand = cand.where((longer <= most) & (counts_apart([("s_a", "s_b"), ("t_a", "t_b")]) + longer <= most * 2))
    return cand.select("a", "b").distinct()


def near_classes(classes: DataFrame, schemes=SCHEMES, jaccard: float = JACCARD, edits: float | None = EDITS) -> DataFrame:
    """Pairs (``a`` of train, ``b`` held out) of different near-same texts.

    ``classes``: rep (long), train, held (booleans), text, salt (long): one row
    per distinct text of a group. Only buckets with both sides give candidates,
    those whose lengths alone exceed the edits are dropped at once, and the rest
    is verified on whole texts: by edit distance, or by ``jaccard`` if ``edits``
    is None. Pairs of at most ``SHORT`` letters are all found if ``edits`` is given.
    """
    parts = []
    for number in range(0, len(schemes), 2):
        own = schemes[number : number + 2]
        total = sum(bands for _, _, bands, _ in own)
        for at in range(0, total, ROUND):  # a few bands at a time, each round's keys released before the next are shuffled
            pairs = bucket_pairs(classes, own, edits, not number and not at, range(at, min(at + ROUND, total)))
            parts.append(stage(pairs, "candidates"))
            release(classes.sparkSession)
    cand = reduce(DataFrame.unionByName, parts).distinct()
    pairs = cand.join(classes.where("held").select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    pairs = pairs.join(classes.where("train").select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
    return pairs.select("a", "b", "x", "y").mapInArrow(_verify(jaccard, edits), "a long, b long")


def split_overlaps(df: DataFrame, key: str, split: str, group: str, text: str, **how) -> DataFrame:
    """Pairs ``row_a`` < ``row_b`` of one group, one in train, one held out, with the same or nearly the same letters.

    Rows are folded to distinct letters per group first, so that a text that
    holds a third of all rows meets the buckets once. Null texts and keys, texts without
    letters and other splits take no part.
    """
    kind = label(split)
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("grp"), kind.alias("split"), F.col(text).alias("raw"))
    rows = rows.where(F.col("split").isin("train", *EVALUATION) & F.col("raw").isNotNull() & F.col("key").isNotNull())
    rows = rows.select("key", "grp", (F.col("split") == "train").alias("train"), letters_of("raw").alias("text")).where("length(text) > 0")
    rows = stage(rows, "letters")
    classes = rows.groupBy("grp", "text").agg(F.min("key").alias("rep"), F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("held"))
    classes = stage(classes.withColumn("salt", F.xxhash64("grp")), "classes")
    near = near_classes(classes, **how)
    same = classes.where("train AND held").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    confirmed = stage(near.unionByName(same), "confirmed")
    # Rows of the confirmed texts: found by 128 bits of the text, so neither a row-to-class table of the others nor the texts are shuffled.
    named = confirmed.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    bits = [F.xxhash64("grp", "text").alias("h"), F.xxhash64(F.lit(1), "text", "grp").alias("i")]
    wanted = classes.join(broadcast_if_small(named), "rep", "left_semi").select(*bits, "rep")
    members = stage(rows.select(*bits, "key", "train").join(broadcast_if_small(wanted), ["h", "i"]).select("key", "train", "rep"), "members")
    # Members in blocks, so that the pairs of two large classes are expanded by many tasks.
    blocks = stage(key_blocks(members, ["rep", "train"], "key", "keys"), "blocks")
    train = blocks.where("train").select(F.col("rep").alias("a"), F.col("keys").alias("xs"))
    held = blocks.where("NOT train").select(F.col("rep").alias("b"), F.col("keys").alias("ys"))
    return crossed(confirmed.join(train, "a").join(held, "b").select("xs", "ys"))


def clip_overlaps(manifest: DataFrame) -> DataFrame:
    return split_overlaps(manifest.withColumn("language", label("language")), "row_id", "split", "language", "transcription")


def overlap_report(manifest: DataFrame) -> DataFrame:
    """Confirmed overlaps by held-out split and dataset: pairs, held-out rows hit and train rows involved."""
    pairs = stage(clip_overlaps(manifest), "overlaps")
    rows = manifest.select("row_id", label("split").alias("split"), label("dataset").alias("dataset"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("row_a").alias("row_id"), F.col("row_b").alias("other")), F.struct(F.col("row_b").alias("row_id"), F.col("row_a").alias("other")))).alias("s")).select("s.*")
    held = sides.join(rows.where(F.col("split").isin(*EVALUATION)), "row_id")
    return held.groupBy("split", "dataset").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("row_id").alias("held_rows"), F.countDistinct("other").alias("train_rows")
    )
