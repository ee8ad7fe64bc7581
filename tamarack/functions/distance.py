"""Edit distances: over letters in the JVM, over words in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: Sequence, b: Sequence, most: int | None = None) -> int:
    """Insertions, deletions and replacements between two sequences, bit-parallel over the shorter one.

    With ``most`` it stops as soon as the distance must exceed it and returns ``most`` + 1.
    """
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    top, plus, minus, distance, left = 1 << (len(b) - 1), full, 0, len(b), len(a)
    for x in a:
        match = where.get(x, 0)
        down = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        up = minus | (~(across | plus) & full)
        same = plus & across
        if up & top:
            distance += 1
        elif same & top:
            distance -= 1
        left -= 1
        if most is not None and distance - left > most:
            return most + 1
        up = (up << 1) | 1
        same <<= 1
        plus = (same | ~(down | up)) & full
        minus = up & down & full
    return distance


@F.pandas_udf(T.LongType())
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edits between two blank-separated texts; null counts as empty."""
    pairs = list(zip(reference, hypothesis, strict=True))
    edits = {(r, h): 0 if r == h else edit_distance((r or "").split(), (h or "").split()) for r, h in set(pairs)}  # each pair once a batch
    return pd.Series([edits[p] for p in pairs], dtype="int64")
