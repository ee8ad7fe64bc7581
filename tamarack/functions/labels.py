"""Label fields (language, subtype, dataset, split) in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks trimmed at the ends of a label, the non-breaking ones included.
BLANKS = " \t\n\x0b\f\r\u00a0\u2007\u202f\u3000\ufeff\u200b"


def stripped(col: Column, blanks: str = BLANKS) -> Column:
    """Without blanks at either end."""
    return F.trim(col, F.lit(blanks))


def label(col: Column | str, unknown: str = "unknown") -> Column:
    """Trimmed, lower-cased label; null or blank becomes ``unknown``."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.lower(stripped(col))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(unknown))


def usable_seconds(col: Column | str) -> Column:
    """A duration that counts: finite and above 0; null otherwise (NaN and infinities included)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when((col > 0) & (col < float("inf")), col)
