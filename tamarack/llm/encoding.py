"""Encoding with a public byte-level BPE vocabulary by recursive DuckDB queries per partition."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import sliced

#: Where the vocabulary lies; a parameter of every function here, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The published pattern that splits a text into words before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows that the steps of one recursive query may come to (half the squared length of each of its words).
CHUNK_ROWS = 3_000_000
#: Longer words (bytes) are encoded in pieces that overlap; characters of a piece and of what it shares with the next.
LONG_WORD, PIECE, SHARED = 384, 128, 64

_WORDS = regex.compile(PATTERN)

# A seat is word << 32 | position. Each step contracts, in every word that still has a
# pair of the merge table, the pair of least rank: its leftmost place and every further
# one that does not overlap an earlier one, which changes nothing, as a contracted pair
# never brings a pair of lower rank about. A word leaves the recursion when no pair is left.
_CONTRACT = """
WITH RECURSIVE step AS (
    SELECT seat, token, 0 AS n FROM start
    UNION ALL
    (
        WITH pair AS MATERIALIZED (
            SELECT seat, token, n, lead(token) OVER line AS after, lead(seat) OVER line AS next FROM step WINDOW line AS (ORDER BY seat)
        ),
        ranked AS MATERIALIZED (
            SELECT p.seat, p.next, p.token = p.after AS twin, m.rank, m.made FROM pair p JOIN merges m ON m.token = p.token AND m.after = p.after
            WHERE p.seat >> 32 = p.next >> 32
        ),
        best AS MATERIALIZED (SELECT seat >> 32 AS word, min((rank::BIGINT << 32) + (seat & 4294967295)) AS least FROM ranked GROUP BY seat >> 32),
        {hit}
        SELECT p.seat, coalesce(h.made, p.token), p.n + 1
        FROM pair p SEMI JOIN best b ON b.word = p.seat >> 32 LEFT JOIN hit h ON h.seat = p.seat ANTI JOIN hit g ON g.next = p.seat
    )
)
SELECT s.seat >> 32 AS word, list(s.token ORDER BY s.seat) AS ids
FROM step s JOIN (SELECT seat >> 32 AS word, max(n) AS last FROM step GROUP BY 1) f ON f.word = s.seat >> 32 AND f.last = s.n
GROUP BY 1 ORDER BY 1
"""
# Of a run of equal tokens every second place. Words without long runs take only its first place in a step, which costs less.
_EVERY = """least AS MATERIALIZED (SELECT r.seat, r.next, r.made, r.twin FROM ranked r JOIN best b ON b.word = r.seat >> 32 AND b.least >> 32 = r.rank),
        hit AS MATERIALIZED (
            SELECT seat, next, made FROM least WHERE NOT twin
            UNION ALL
            SELECT seat, next, made FROM (
                SELECT *, row_number() OVER (PARTITION BY run ORDER BY seat) AS nth FROM (
                    SELECT *, sum(begins) OVER (ORDER BY seat) AS run FROM (
                        SELECT *, (lag(next) OVER (ORDER BY seat) IS DISTINCT FROM seat)::INT AS begins FROM least WHERE twin
                    )
                )
            ) WHERE nth % 2 = 1
        )"""
_FIRST = """hit AS MATERIALIZED (
            SELECT r.seat, r.next, r.made FROM ranked r JOIN best b ON b.word = r.seat >> 32 AND b.least >> 32 = r.rank
            WHERE NOT r.twin OR r.seat & 4294967295 = b.least & 4294967295
        )"""
#: Characters up to which a word's runs are too short to matter.
RUN_WORD = 24
_RUN = regex.compile(r"(.{1,4}?)\1{5}", regex.DOTALL)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[pa.Table, dict[int, int], dict[int, bytes]]:
    """The merge table (token, after, rank, made), the id of each single byte and the bytes of each id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = pa.table(
        {
            "token": pa.array([ids[a] for a, _ in pairs], pa.int32()),
            "after": pa.array([ids[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "made": pa.array([ids[a + b] for a, b in pairs], pa.int32()),
        }
    )
    symbols = byte_symbols()
    back = {s: b for b, s in symbols.items()}
    raw = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
    return merges, {b: ids[s] for b, s in symbols.items()}, raw


class Encoder:
    """Encodes texts through one DuckDB connection; words met before are looked up."""

    def __init__(self, path: str = VOCABULARY, keep_words: int = 200_000):
        merges, single, self.raw = vocabulary(path)
        self.first = np.array([single[b] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '400MB'")
        self.db.execute("SET temp_directory = ''")  # nothing is left in a worker's folder
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.known: dict[str, list[int]] = {}
        self.keep_words = keep_words

    def _words(self, words: list[str], runs: bool) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        start = pa.table({"seat": (word << 32) + pos, "token": token})
        self.db.register("start", start)
        out = self.db.execute(_CONTRACT.replace("{hit}", _EVERY if runs else _FIRST)).fetchall()
        self.db.unregister("start")
        return [ids for _, ids in out]

    def _chunked(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of each word, by recursive queries of bounded size."""
        out: dict[str, list[int]] = {}
        with_runs = {w for w in words if len(w) > RUN_WORD and _RUN.search(w)}
        for runs, own in ((False, words - with_runs), (True, with_runs)):
            sized = sorted((len(w.encode("utf-8", "surrogatepass")), w) for w in own)  # words of one length take as many steps
            chunk, rows = [], 0
            for size, w in sized:
                if chunk and rows + size * size // 2 > CHUNK_ROWS:
                    out.update(zip(chunk, self._words(chunk, runs), strict=True))
                    chunk, rows = [], 0
                chunk.append(w)
                rows += size * size // 2 + 1
            if chunk:
                out.update(zip(chunk, self._words(chunk, runs), strict=True))
        return out

    def _long(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of words too long for one query, from pieces that overlap.

        Ids are a word's encoding if each two neighbours are the encoding of their own text. Two pieces that share a token
        at the same place can therefore be joined there. Pieces that share none (repeated patterns out of phase) are encoded as one.
        """
        spans = {w: [(a, min(a + PIECE + SHARED, len(w))) for a in range(0, max(len(w) - SHARED, 1), PIECE)] for w in words}
        done: dict[str, list[int]] = {}
        while spans:
            known = self._chunked({w[a:b] for w, own in spans.items() for a, b in own})
            apart: dict[str, list[tuple[int, int]]] = {}
            for w, own in spans.items():
                joined: list[int] = []
                ends: list[int] = []
                wrong = set()
                for i, (a, b) in enumerate(own):
                    ids = known[w[a:b]]
                    at = len(w[:a].encode("utf-8", "surrogatepass")) if not i else start + len(w[begin:a].encode("utf-8", "surrogatepass"))
                    begin, start = a, at
                    new = (at + np.cumsum([len(self.raw[t]) for t in ids])).tolist()
                    if i:
                        here = {e: k for k, e in enumerate(new)}
                        k = next((k for k in range(len(ends) - 1, -1, -1) if ends[k] <= at or (ends[k] in here and joined[k] == ids[here[ends[k]]])), -1)
                        if k < 0 or ends[k] <= at:
                            wrong.add(i)
                            joined, ends = joined + ids, ends + new
                            continue
                        cut = here[ends[k]] + 1
                        joined, ends = joined[: k + 1] + ids[cut:], ends[: k + 1] + new[cut:]
                    else:
                        joined, ends = ids, new
                if wrong:
                    merged: list[tuple[int, int]] = []
                    reach = -1  # a piece that does not fit takes as much again in, so the rounds are few
                    for i, span in enumerate(own):
                        if i in wrong:
                            reach = merged[-1][0] + 2 * (span[1] - merged[-1][0])
                        if i in wrong or span[0] < reach:
                            merged[-1] = (merged[-1][0], span[1])
                        else:
                            merged.append(span)
                    apart[w] = merged
                else:
                    done[w] = joined
            spans = apart
        return done

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [_WORDS.findall(t) if t else [] for t in texts]
        if len(self.known) > self.keep_words:
            self.known = {}
        new = {w for ws in split for w in ws if w not in self.known}
        long = [w for w in new if len(w) > LONG_WORD // 4 and len(w.encode("utf-8", "surrogatepass")) > LONG_WORD]
        known = self.known
        known.update(self._chunked(new.difference(long)))
        own = known | self._long(long) if long else known  # long words are not kept
        return [[i for w in ws for i in own[w]] for ws in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts again, by ordered aggregation of the tokens' bytes."""
        row, pos, raw = [], [], []
        for k, own in enumerate(ids):
            row += [k] * len(own)
            pos += range(len(own))
            raw += [self.raw[i].hex() for i in own]
        self.db.register("coded", pa.table({"row": pa.array(row, pa.int64()), "pos": pa.array(pos, pa.int64()), "raw": pa.array(raw, pa.string())}))
        found = dict(self.db.execute("SELECT row, string_agg(raw, '' ORDER BY pos) FROM coded GROUP BY row").fetchall())
        self.db.unregister("coded")
        return [bytes.fromhex(found.get(k, "")).decode("utf-8", "surrogatepass") for k in range(len(ids))]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, whose known words serve one task after the other."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids = encoder_of(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are
    ordinary text. Whole texts are encoded, nothing is shuffled, repeated ids
    give repeated rows and other columns are not read.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = encoder.encode(texts)
            same = [a == (b or "") for a, b in zip(encoder.decode(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "same"])

    return run


def round_trip(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Number of ids of each document, and whether decoding them gives its text again."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_round_trip(path), "doc_id long, n_ids int, same boolean")
