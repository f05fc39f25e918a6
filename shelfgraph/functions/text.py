"""Small string building blocks shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every Unicode space on both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse_spaces(c) -> Column:
    """Trim, and turn each inner run of spaces into one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cs) -> Column:
    """First argument that is neither null nor blank, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def contains_ci(c, term) -> Column:
    """Case-insensitive substring test; ``term`` is a literal or a Column."""
    needle = F.lower(F.lit(term)) if isinstance(term, str) else F.lower(term)
    return F.lower(F.coalesce(col(c), F.lit(""))).contains(needle)


def ascii_digits(c) -> Column:
    """Full-width digits to ASCII digits."""
    return F.translate(col(c), "".join(chr(0xFF10 + i) for i in range(10)), "0123456789")


def to_hiragana(c) -> Column:
    """Katakana to hiragana; the two blocks lie 0x60 code points apart."""
    katakana = "".join(chr(p) for p in range(0x30A1, 0x30F7))
    hiragana = "".join(chr(p - 0x60) for p in range(0x30A1, 0x30F7))
    return F.translate(col(c), katakana, hiragana)
