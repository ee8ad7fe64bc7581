"""Character-level forms of a text: its letters, its visible form and its consistent form.

All three are pure functions of a string (null gives null) and come as Arrow
UDFs that work through each batch's distinct values once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of other scripts and forms that look like a Latin
# letter, with that letter (Unicode's published confusables, single letters only;
# Latin letters that orthographies tell apart are left out).
_PAIRS = (
    ("ЅІЈАВЕКМНОРСТУХЬѴҮҺӀԌԚԜ", "SIJABEKMHOPCTYXbVYHlGQW"),  # Cyrillic capitals
    ("агеорсухѕіјѡѵүһҽӏԁԛԝꙇ", "areopcyxsijwvyheidqwi"),  # Cyrillic small letters
    ("ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺ", "JABEZHIKMNOPTYXFCM"),  # Greek capitals
    ("αγινορσυϲϳ", "ayivopoucj"),  # Greek small letters
    ("ՍՏՕազհոռսցքօ", "USOwqhnnugfo"),  # Armenian
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"),  # Cherokee
    ("ꭵꮁꮃꮓꮩꮪꮯ", "irwzvsc"),  # Cherokee small letters
    ("ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "rHIKMNOoPpCcTYX"),  # Coptic
    ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡıȷɪʏᴄᴏᴑᴜᴠᴡᴢꜱ", "agijiycoouvwzs"),  # Latin variants and small capitals
)
LOOKALIKE = {a: b for left, right in _PAIRS for a, b in zip(left, right, strict=True)}

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_LETTER = regex.compile(r"[\p{L}\p{M}\p{N}]")
_BLANK = regex.compile(r"[\s\p{Z}]")
#: Blanks that do not break a line and look like one plain space.
_FIXED_BLANKS = "\u00a0\u2007\u202f"
#: Compatibility forms a reader tells from the plain ones stay as they are.
_SEEN_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<font>")


class _PerCharacter(dict):
    """A translate table that works each character out once."""

    def __init__(self, rule):
        self.rule = rule

    def __missing__(self, code):
        value = self[code] = self.rule(chr(code))
        return value


def _plain(ch: str) -> str:
    """One character without its compatibility form, look-alikes as the Latin letter."""
    if _IGNORABLE.match(ch):
        return ""
    return "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFKC", ch))


def _letter(ch: str) -> str:
    low = "".join(LOOKALIKE.get(c, c) for c in _plain(ch).lower())
    return "".join(c for c in low if _LETTER.match(c) and not _IGNORABLE.match(c))


def _seen(ch: str) -> str:
    if _IGNORABLE.match(ch):
        return ""
    if ch in _FIXED_BLANKS:
        return " "
    if unicodedata.decomposition(ch).startswith(_SEEN_FORMS) or (_BLANK.match(ch) and ch != "\u3000"):
        return ch
    return _plain(ch)


def _consistent(ch: str) -> str:
    if _BLANK.match(ch):
        return " "
    return _plain(ch).casefold()


_LETTERS, _SEEN, _CONSISTENT = _PerCharacter(_letter), _PerCharacter(_seen), _PerCharacter(_consistent)


def letters(text: str | None) -> str | None:
    """Letters (with their accents) and digits in order, lower-cased, look-alikes as the same letter."""
    if text is None:
        return None
    out = text.translate(_LETTERS)
    return out if out.isascii() else unicodedata.normalize("NFC", out)


def has_letters(text: str) -> bool:
    return any(_LETTERS[ord(ch)] for ch in text)


def letter_places(text: str) -> tuple[list[int], list[int]]:
    """For each of a text's letters, the code point where it begins and the one after its end.

    Characters that the composed form joins are one cluster, whose letters share its place.
    """
    if unicodedata.is_normalized("NFC", text.translate(_LETTERS)):  # each character keeps its own letters
        places = [i for i, ch in enumerate(text) for _ in _LETTERS[ord(ch)]]
        return places, [i + 1 for i in places]
    starts, ends, cluster, first, last = [], [], "", 0, 0
    for i, ch in enumerate(text):
        own = _LETTERS[ord(ch)]
        if not own:
            continue
        apart = not cluster or (
            not unicodedata.combining(own[0]) and unicodedata.normalize("NFC", cluster + own) == unicodedata.normalize("NFC", cluster) + unicodedata.normalize("NFC", own)
        )
        if apart:
            made = len(unicodedata.normalize("NFC", cluster))
            starts += [first] * made
            ends += [last] * made
            cluster, first = "", i
        cluster += own
        last = i + 1
    made = len(unicodedata.normalize("NFC", cluster))
    return starts + [first] * made, ends + [last] * made


def visible(text: str | None) -> str | None:
    """The text as a reader sees it: equal for texts that look the same, case, marks and blanks kept."""
    if text is None:
        return None
    out = text.translate(_SEEN)
    return out if out.isascii() else unicodedata.normalize("NFC", out)


def consistent(text: str | None) -> str | None:
    """One form for comparisons: compatibility-composed, fully case-folded, blanks as single spaces, no ignorables."""
    if text is None:
        return None
    out = text.translate(_CONSISTENT)
    if not out.isascii():
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", out).casefold())
    return " ".join(out.split())


def per_distinct(fn, values: pd.Series) -> pd.Series:
    """``fn`` once for each distinct value of the batch."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    mapped = pd.Series([fn(v) for v in distinct] + [None], dtype="object")
    return mapped.take(codes).reset_index(drop=True)


@F.pandas_udf(T.StringType())
def letters_of(text: pd.Series) -> pd.Series:
    return per_distinct(letters, text)


@F.pandas_udf(T.StringType())
def visible_form(text: pd.Series) -> pd.Series:
    return per_distinct(visible, text)


@F.pandas_udf(T.StringType())
def consistent_form(text: pd.Series) -> pd.Series:
    return per_distinct(consistent, text)
