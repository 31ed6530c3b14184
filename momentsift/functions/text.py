"""Text normalisation as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _folding(form: str) -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Of lower-case characters: those whose decomposition is one character, what it is, those that grow, and all that decompose."""
    one, to, grow, marked = [], [], [], []
    for code in range(0x80, 0x2_0000 if sys.maxunicode > 0x2_0000 else 0x1_0000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or unicodedata.combining(c) or form == "NFD" and not c.isalpha():
            continue
        d = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if d != c and d:
            marked.append(c)
            if c == c.lower() or c.lower() == c:
                if len(d) == 1:
                    one.append(c)
                    to.append(d.lower())
                else:
                    grow.append((c, d.lower()))
    return "".join(one), "".join(to), tuple(grow), "".join(marked)


def _ranges(characters) -> str:
    """A pattern of one of the characters; the many ranges are tried one by one, so those between which all lie come first."""
    marked = sorted(characters)
    ranges, start = [], marked[0]
    for a, c in zip(marked, [*marked[1:], "\U0010ffff"], strict=True):
        if ord(c) != ord(a) + 1:
            ranges.append(f"\\x{{{ord(start):x}}}-\\x{{{ord(a):x}}}")
            start = c
    return f"[\\x{{{ord(marked[0]):x}}}-\\x{{{ord(marked[-1]):x}}}&&[{''.join(ranges)}]]"


def _strip_marks(text: Column, form: str) -> Column:
    one, to, grow, _ = _folding(form)
    folded = F.translate(F.lower(text), one, to)
    if form == "NFKD":
        # A map is searched key by key, so it is asked once for each different character that grows, not for each character of the text.
        longer = F.str_to_map(F.lit("\x01".join(f"{c}\x02{d}" for c, d in grow)), F.lit("\x01"), F.lit("\x02"))
        growing = _ranges([c for c, _ in grow])
        met = F.array_distinct(F.regexp_extract_all(folded, F.lit(growing), F.lit(0)))
        folded = F.when(folded.rlike(growing), F.aggregate(met, folded, lambda s, c: F.replace(s, c, F.try_element_at(longer, c)))).otherwise(folded)
    folded = F.regexp_replace(folded, r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)  # ASCII has no marks


def fold(text: Column) -> Column:
    """Compatibility decomposition without marks, lower case; ``đ`` has no decomposition and stays."""
    return _strip_marks(text, "NFKD")


def fold_d(text: Column) -> Column:
    """Canonical decomposition without marks, lower case, ``đ`` as ``d``."""
    return F.translate(_strip_marks(text, "NFD"), "đ", "d")


PUNCTUATION = r"""[.,!?;:'"()\[\]{}]"""


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_answer(text: Column) -> Column:
    """Lower case without punctuation, accents kept; null is empty. Compare with ``same_text``, which equates composed and decomposed letters."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def same_text(a: Column, b: Column) -> Column:
    return F.collate(a, "UNICODE") == F.collate(b, "UNICODE")


def has_diacritics(text: Column) -> Column:
    """Is there a letter beyond ASCII that decomposes?"""
    return text.rlike(_ranges(_folding("NFD")[3]))


def terms(text: Column) -> Column:
    """Lower-case terms without marks, cut where there is neither letter nor digit."""
    return F.filter(F.split(fold_terms(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def fold_terms(text: Column) -> Column:
    return _strip_marks(text, "NFD")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
