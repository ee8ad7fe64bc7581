"""Evaluation texts leaking into documents: a broadcast set of test n-grams, scanned windows, verified hits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .letters import letter_places, letters

#: Share of an item's letters that one stretch must hold, and changes allowed in the stretch.
HELD, CHANGED = 0.5, 0.1
#: Longest n-gram looked up.
LONG_GRAM = 5
#: Letters of items in one broadcast set; more items are scanned in several blocks.
BLOCK_LETTERS = 4_000_000
#: Letters of documents scanned together, and cells of one alignment table; both bound memory, not results.
SCANNED_LETTERS, TABLE_CELLS = 200_000, 2_000_000
_NO_LETTER = np.uint32(0xFFFFFFFF)
#: Neighbouring slots of diagonals looked at together.
_MERGED = 3


def edits_of(letters_held: int) -> int:
    return int(letters_held * CHANGED + 1e-9)


def lengths_of(least: int, most: int) -> list[int]:
    """The lengths from ``least`` to ``most`` at which a stretch keeps least: the first, and each that allows one more edit."""
    return [least, *(m for m in range(least + 1, most + 1) if edits_of(m) > edits_of(m - 1))]


def gram_of(least: int) -> int:
    """The longest n-gram of which a stretch of at least ``least`` letters keeps one whatever its changes.

    A stretch of m letters with e changes keeps m + 1 - n (e + 1) of its n-grams.
    """
    for n in range(LONG_GRAM, 1, -1):
        if all(m + 1 - n * (edits_of(m) + 1) >= 1 for m in range(least, max(least, 10 * n) + 30)):
            return n
    return 1


def _rolling(codes: np.ndarray, sizes) -> dict[int, np.ndarray]:
    """Hashes of the n-grams of each wanted n, from one pass that lengthens them letter by letter."""
    out, h = {}, np.zeros(len(codes), np.uint32)
    for i in range(max(sizes, default=0)):
        h = h[: max(len(codes) - i, 0)]
        h = (h ^ codes[i : i + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if i + 1 in sizes:
            out[i + 1] = h
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def going_on(least: int, most: int) -> list[int]:
    """For each number of edits, the length that a stretch with so many must have if one with more can still be long enough.

    A stretch with more edits falls into pieces of at most e edits each, parted by one edit.
    """
    ends = [(edits_of(m), m) for m in lengths_of(least, most)]
    out = []
    for e in range(min(ends[-1][0], 60) + 1):
        pieces = [(-(-(f + 1) // (e + 1)), m) for f, m in ends if f >= e]
        out.append(min(-(-(m - q + 1) // q) for q, m in pieces))
    return out


class ItemSet:
    """The n-grams of a block of test items, sorted for look-up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.least = [max(1, -(-len(c) // 2)) for c in self.codes]
        self.go = [going_on(m, len(c)) for m, c in zip(self.least, self.codes, strict=True)]
        self.by_gram = {}
        self.sizes = {gram_of(m) for m in self.least}
        hashed = [_rolling(c, self.sizes) for c in self.codes]
        for n in sorted(self.sizes):
            owners = [k for k, c in enumerate(self.codes) if gram_of(self.least[k]) == n and len(c) >= n]
            if not owners:
                continue
            grams = np.concatenate([hashed[k][n] for k in owners])
            owner = np.repeat(owners, [len(hashed[k][n]) for k in owners])
            place = np.concatenate([np.arange(len(hashed[k][n])) for k in owners])
            order = np.argsort(grams, kind="stable")
            distinct, first, count = np.unique(grams[order], return_index=True, return_counts=True)
            maybe = np.zeros(1 << 20, bool)  # rules most n-grams of a document out before they are searched for
            maybe[distinct >> np.uint32(12)] = True
            self.by_gram[n] = (maybe, distinct, first, count, owner[order].astype(np.int64), place[order])
        # A stretch may be as long as the item; its edits shift its diagonals, and a longer one may keep fewer n-grams.
        self.width = np.array([edits_of(len(c)) + 1 for c in self.codes], np.int64)
        own = [(gram_of(m), lengths_of(m, len(c))) for m, c in zip(self.least, self.codes, strict=True)]
        self.kept = np.array([max(1, min(m + 1 - n * (edits_of(m) + 1) for m in ms)) for n, ms in own], np.int64)

    def candidates(self, docs: np.ndarray, number: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first diagonal, diagonals) at which an item may stand; a diagonal is the place in the document minus that in the item.

        ``docs`` are the letters of many documents, ``number`` the document of each letter, ``begin`` where each begins.
        """
        hashed = _rolling(docs, self.sizes)
        for n, (maybe, distinct, first, count, owner, place) in self.by_gram.items():
            own = hashed[n]
            hit = np.flatnonzero(maybe[own >> np.uint32(12)])
            if not len(hit):
                continue
            entry = np.minimum(np.searchsorted(distinct, own[hit]), len(distinct) - 1)
            there = distinct[entry] == own[hit]
            hit, entry = hit[there], entry[there]
            if not len(hit):
                continue
            times = count[entry]
            at = np.repeat(hit, times)
            ends = np.cumsum(times)
            entry = np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(first[entry], times)
            item, doc = owner[entry], number[at]
            pair = doc * len(self.codes) + item
            totals = np.bincount(pair)
            there = np.flatnonzero(totals)
            there = there[totals[there] >= self.kept[there % len(self.codes)]]  # most pairs share a phrase only
            if not len(there):
                continue
            compact = np.full(len(totals), -1, np.int64)
            compact[there] = np.arange(len(there))
            here = compact[pair]
            enough = here >= 0
            slot = (at[enough] - begin[doc[enough]] - place[entry[enough]]) // self.width[item[enough]]
            key = np.sort((here[enough] << 32) + (slot + (1 << 30)))
            first_of = np.flatnonzero(np.diff(key, prepend=-1))
            key, hits = key[first_of], np.diff(first_of, append=len(key))
            # The diagonals of a true stretch lie in two neighbouring slots, which hold what it keeps of its n-grams.
            spread = np.sort(np.concatenate([key, key - 1]))
            spread = spread[np.flatnonzero(np.diff(spread, prepend=-1))]
            both = np.zeros(len(spread), np.int64)
            for shift in (0, 1):
                where = np.minimum(np.searchsorted(key, spread + shift), len(key) - 1)
                both += np.where(key[where] == spread + shift, hits[where], 0)
            doc, item = np.divmod(there[spread >> 32], len(self.codes))
            keep = both >= self.kept[item]
            spread, doc, item = spread[keep], doc[keep], item[keep]
            if not len(spread):
                continue
            begins = np.flatnonzero(np.diff(spread, prepend=-9) > 1)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(spread)], strict=True):
                for k in range(a, b, _MERGED):
                    width = int(self.width[item[k]])
                    slot = (int(spread[k]) & 0xFFFFFFFF) - (1 << 30)
                    yield int(doc[k]), int(item[k]), slot * width, (min(k + _MERGED, b) - k + 1) * width

    def stretch(self, doc: np.ndarray, item: int, diagonal: int, width: int) -> tuple[int, int, int] | None:
        """The longest stretch (document start, end, letters of the item) with few enough changes on these diagonals."""
        own = self.codes[item]
        low, high = max(diagonal, -len(own)), min(diagonal + width, len(doc))
        if high <= low:
            return None
        before, after = max(0, -low), max(0, high + len(own) - 1 - len(doc))
        part = doc[max(low, 0) : high + len(own) - 1]
        if before or after:
            part = np.concatenate([np.full(before, _NO_LETTER), part, np.full(after, _NO_LETTER)])
        found = longest_stretch(own, part, self.least[item], self.go[item])
        return found and (max(low + found[0], 0), min(low + found[1], len(doc)), found[2])


def longest_stretch(own: np.ndarray, part: np.ndarray, least: int, go: list[int], cells: int = TABLE_CELLS) -> tuple[int, int, int] | None:
    """(start and end in ``part``, letters held) of the longest stretch of ``own`` with at most one change in ten; exact.

    ``part[k + i]`` stands against ``own[i]`` on diagonal k. Of each cell (diagonal, letters of ``own`` read) the table holds the earliest start,
    and its diagonal, of a stretch that ends there with at most e edits. One more edit moves a cell from
    its neighbours (a replaced, a left out, an added letter), and runs of equal letters carry it on for nothing: a
    running minimum that begins anew at each unequal letter. Rows of ``own`` are taken in blocks of ``cells``;
    between blocks one column for each number of edits is kept.
    """
    size, lines = len(own), len(part) - len(own) + 1
    most, rows = edits_of(size), max(1, min(size, cells // lines))
    kind = np.int32 if (size + 1) * (size + 1) * lines < 2**31 else np.int64
    line = np.arange(lines, dtype=kind)[:, None]
    kept: list[np.ndarray] = [line[:, 0]] * (most + 1)
    best, found = least - 1, None
    for a in range(0, size, rows):
        b = min(a + rows, size)
        same = np.ndarray((lines, b - a), part.dtype, np.ascontiguousarray(part[a : b + lines - 1]), strides=(part.itemsize, part.itemsize)) == own[a:b]
        read = np.arange(a, b + 1, dtype=kind)
        start = np.empty((lines, b - a + 1), kind)
        start[:, 0] = kept[0] // lines
        start[:, 1:] = np.where(same, 0, read[1:])
        np.maximum.accumulate(start, axis=1, out=start)
        anew = start * kind((size + 1) * lines)
        table = start * kind(lines) + line
        reach, nexts = read * kind(lines), []
        for e in range(most + 1):
            if e:
                longer = table.copy()
                np.minimum(longer[:, 1:], table[:, :-1], out=longer[:, 1:])
                np.minimum(longer[:-1, 1:], table[1:, :-1], out=longer[:-1, 1:])
                np.minimum(longer[1:], table[:-1], out=longer[1:])
                if a:
                    longer[:, 0] = kept[e]
                longer -= anew
                np.minimum.accumulate(longer, axis=1, out=longer)
                longer += anew
                table = longer
            nexts.append(table[:, -1].copy())
            held = reach - table
            longest = -(-int(held.max()) // lines)
            if longest > best and edits_of(longest) >= e:
                k, i = divmod(int(held.argmax()), held.shape[1])
                began, on = divmod(int(table[k, i]), lines)
                best, found = longest, (began + on, a + i + k, longest)
            if rows >= size and (longest >= size or (e < len(go) and longest < go[e])):
                break
        kept = nexts
    return found


def leaks_in(texts: list[str], items: ItemSet) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text (index of the item, number, start, end, letters of the item held) of each stretch it leaks, in code points.

    Stretches of one item that overlap in a text are one, the longest, which has number 1.
    """
    own = [letters(t) for t in texts]
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    a = 0
    while a < len(texts):
        b, size = a + 1, len(own[a])
        while b < len(texts) and size + len(own[b]) < SCANNED_LETTERS:
            size += len(own[b])
            b += 1
        docs = [_codes(t) for t in own[a:b]]
        sizes = np.array([len(d) + 1 for d in docs])
        apart = [x for d in docs for x in (d, np.array([_NO_LETTER]))]
        begin = np.cumsum(sizes) - sizes
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for doc, item, diagonal, width in items.candidates(np.concatenate(apart), np.repeat(np.arange(b - a), sizes), begin):
            if hit := items.stretch(docs[doc], item, diagonal, width):
                found.setdefault((doc, item), set()).add(hit)
        for doc in sorted({d for d, _ in found}):
            starts, ends = letter_places(texts[a + doc])
            for item in sorted(i for d, i in found if d == doc):
                taken: list[tuple[int, int]] = []
                for s, e, held in sorted(found[doc, item], key=lambda x: (-x[2], x)):
                    if all(e <= x or y <= s for x, y in taken):
                        taken.append((s, e))
                        out[a + doc].append((item, len(taken), starts[s], ends[e - 1], held))
        a = b
    return out


_SETS: dict[str, ItemSet] = {}


def _items(token: str, shared) -> ItemSet:
    """The item set of a broadcast, built once in each Python worker; only the last one is kept."""
    if token not in _SETS:
        _SETS.clear()
        _SETS[token] = ItemSet(shared.value)
    return _SETS[token]


def _scan(shared, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(token, shared)
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            distinct = list(dict.fromkeys(texts))
            leaks = dict(zip(distinct, leaks_in(distinct, items), strict=True))
            rows = [
                (key, items.ids[i], n, a, b, held, held / len(items.codes[i]))
                for key, text in zip(batch.column(0).to_pylist(), texts, strict=True) for i, n, a, b, held in leaks[text]
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "item_id", "stretch", "start", "end", "held", "share"]
_SCHEMA = "doc_id long, item_id long, stretch long, start long, end long, held long, share double"


def leaked_spans(documents: DataFrame, items: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Each stretch of a document that holds at least half of an item's letters.

    ``documents``: doc_id, text; ``items``: item_id, text. ``start`` and ``end``
    are code points of the document's text, ``held`` the item's letters. A document gives a row for each stretch
    that does not overlap a longer one of the same item (``stretch`` numbers them). Documents are read once per block of items,
    so the broadcast set stays below ``block_letters`` letters however many items
    there are (a single longer item is a block of its own). Null, empty and letterless texts on either side leak nothing;
    repeated item ids give repeated rows of their own; documents are scanned
    whole, and nothing is shuffled.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.length("text"), F.lit(0))
    bare = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    total = bare.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_letters))
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    out = None
    for block in range(blocks):
        own = bare.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = [(r["item_id"], letters(r["text"])) for r in own.collect()]  # at most about block_letters letters
        shared = spark.sparkContext.broadcast([(i, t) for i, t in held if t])
        part = texts.mapInArrow(_scan(shared, uuid.uuid4().hex), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id``, once for each document and item it leaks; nothing is shuffled."""
    return leaked_spans(documents, items).where("stretch = 1").select("doc_id", "item_id")


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that leak an item; all their columns pass through."""
    leaked = leaked_spans(documents.select("doc_id", "text"), items).select("doc_id").distinct()
    return documents.join(leaked, "doc_id", "left_anti")


def trimmed_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every document with the leaked stretches cut out; ``doc_id`` must be unique.

    The spans of a document are gathered in its row, which they fit as their number is bounded by its letters and the items.
    """
    spans = leaked_spans(documents, items).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    rows = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def cut(done, span):
        part = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(done["kept"], part).alias("kept"), F.greatest(done["at"], span["end"]).alias("at"))

    whole = F.aggregate("_spans", zero, cut, lambda d: F.concat(d["kept"], F.substring(F.col("text"), (d["at"] + 1).cast("int"), F.length("text"))))
    return rows.select("doc_id", F.coalesce(whole, F.col("text")).alias("text"))
