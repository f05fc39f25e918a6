"""Rows that every operator has to cope with, and plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, host string, row string, digest string, _row string"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of wine and thyme near the old stone bridge. "
LONG = " ".join(f"word{i % 977} thing{i % 131}, été" for i in range(60_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; the extra columns have names that operators use themselves."""
    texts = [PROSE, None, "", PROSE, PROSE.upper(), "one two", "two", "   \n\t ", LONG, PROSE * 5, PROSE * 5 + "End.", "naïve café 日本語 ▁ x", "a\x00b",
             "line one is here\nline one is here\n\nlast", PROSE]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, "h", "r", "d", "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[2], (None, PROSE, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
             (5, "another text under an id that is taken", "en", None, 1, 1, None, None, None, None)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate(LOWER)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
