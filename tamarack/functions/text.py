"""Text and identifier expressions: JVM-side throughout, but for the Unicode composition steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters the punctuation rules keep beside letters, digits,
# underscore and white space. The escapes spell the ranges out for the JVM.
SPACE = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{L}\p{N}_" + SPACE
_LATIN = r"\x{C0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}"
PUNCTUATION = f"[^{_WORD}{_LATIN}'\\x{{2019}}\\x{{14B}}\\x{{14A}}]"
PUNCTUATION_NO_APOSTROPHE = f"[^{_WORD}{_LATIN}]"
FINAL_PUNCTUATION = f"[{SPACE}.,!?:;\\x{{964}}\\x{{61F}}]+$"


def _composed(form: str):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize(form, s))

    return run


_cache: dict = {}


def compose(col: Column, form: str = "NFC") -> Column:
    """Unicode normal form; ASCII passes untouched. The one step Spark has no function for."""
    if form not in _cache:
        _cache[form] = _composed(form)
    return _cache[form](col)


def squeeze(col: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def normalize_text(col: Column) -> Column:
    """Composed, lower-cased, punctuation as blanks, blanks squeezed; null becomes empty."""
    low = F.lower(compose(F.coalesce(col, F.lit(""))))
    return squeeze(F.regexp_replace(low, PUNCTUATION, " "))


def normalize_plain(col: Column) -> Column:
    """Lower-cased with punctuation and apostrophes deleted, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(squeeze(col)), PUNCTUATION_NO_APOSTROPHE, ""))


def normalize_eval(col: Column) -> Column:
    """Lower-cased without accents, everything but letters and digits as blanks."""
    bare = F.regexp_replace(compose(F.lower(col), "NFD"), r"\p{Mn}", "")
    return squeeze(F.regexp_replace(bare, f"[^{_WORD}]", " "))


def _or_dot(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("."))


def collapse_ws(col: Column) -> Column:
    return _or_dot(squeeze(col))


def strip_final_punct(col: Column) -> Column:
    return _or_dot(squeeze(F.regexp_replace(collapse_ws(col), FINAL_PUNCTUATION, "")))


def strip_all_punct(col: Column) -> Column:
    return collapse_ws(F.regexp_replace(col, PUNCTUATION, " "))


def lower_strip_punct(col: Column) -> Column:
    return strip_all_punct(F.lower(col))


def submission_text(col: Column) -> Column:
    return _or_dot(normalize_text(col))


def present(col: Column) -> Column:
    """The value itself unless it is null or blank."""
    return F.when(F.rlike(col, F.lit(f"[^{SPACE}]")), col)


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor blank, unstripped."""
    return F.coalesce(*[present(c) for c in cols])


def clean_number(col: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(col), col)


def content_id(language: Column, *parts: Column) -> Column:
    joined = F.concat_ws("\x00", *[F.coalesce(p, F.lit("None")) for p in parts])
    return F.concat(language, F.lit("-"), F.substring(F.sha1(joined), 1, 16))


def stable_id(prefix: Column, *parts: Column) -> Column:
    joined = F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(joined), 1, 20))


def short_digest(col: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(col), 1, size)


def clip_id(prefix: Column, key: Column, variant: str = "orig") -> Column:
    safe = F.substring(F.regexp_replace(key, "[^A-Za-z0-9_.-]+", "_"), 1, 180)
    return F.concat(prefix, F.lit("_"), safe, F.lit(f"_{variant}"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def words(col: Column) -> Column:
    """White-space tokens; an empty text has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value worked out once, where array functions would repeat it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
