"""Titles: base title, volume number, linkage form, search tokens."""

from __future__ import annotations

from itertools import groupby
from unicodedata import category, combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgraph.functions.text import ascii_digits, col, strip

# Fixed values.
SPIN_OFF_KEYWORDS = ["remains", "外伝", "番外編", "another", "side story", "spin-off", "スピンオフ"]
_VOLUME_SUFFIX = r"第\d+巻?|\(\d+\)|vol\.\s*\d+|volume\s*\d+|巻\d+|その\d+"


def work_title(name, volume) -> Column:
    """Title of a book without its volume number."""
    vol = F.coalesce(col(volume).cast("string"), F.lit(""))
    return strip(F.when(vol == "", col(name)).otherwise(F.replace(col(name), F.concat(F.lit(" "), vol), F.lit(""))))


def work_key(name, volume) -> Column:
    """Grouping key of the books of one work."""
    return F.upper(work_title(name, volume))


def base_title(c) -> Column:
    """Title left of an alias, without trailing volume marks and numbers."""
    left = strip(F.substring_index(col(c), " = ", 1))
    no_suffix = F.regexp_replace(left, rf"(?iU)(?:\s*(?:{_VOLUME_SUFFIX}))+$", "")
    return strip(F.regexp_replace(no_suffix, r"(?U)\s*\d+$", ""))


def volume_number(title, volume) -> Column:
    """Numeric volume field, else the digits that end the title, else null."""
    field = ascii_digits(strip(col(volume).cast("string")))
    tail = ascii_digits(F.regexp_extract(strip(title), r"(?U)(\d+)$", 1))
    return F.coalesce(
        F.when(field.rlike(r"^\d+$"), field.try_cast("int")), F.nullif(tail, F.lit("")).try_cast("int")
    )


def is_spin_off(c) -> Column:
    return F.lower(col(c)).rlike("|".join(SPIN_OFF_KEYWORDS))


def linkage_title(c) -> Column:
    """Title reduced for matching: no dashes, marks or spaces, then no bracketed text; null becomes ''."""
    packed = F.regexp_replace(strip(c), r"(?U)[～〜\-!?！？\s]+", "")
    return F.coalesce(strip(F.regexp_replace(packed, r"[\(（].*?[\)）]", "")), F.lit(""))


def levenshtein_similarity(a, b) -> Column:
    """1 - distance / longer length; 1.0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


# The analyzer of titles and search terms. ------------------------------------------------------------------------------------

# Unicode blocks (fixed values): characters that are tokens by themselves, Han and hiragana, and katakana, whose runs are tokens.
_SINGLE = [(0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3041, 0x3096), (0x309D, 0x309F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
           (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_KATAKANA = [(0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]
# Letters without a Unicode decomposition, and what they fold to (fixed values).
_UNDECOMPOSED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŋ": "n", "ŧ": "t", "ĸ": "q"}
_FOLDED_BLOCKS = [(0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF10, 0xFF5A)]  # accented Latin, ligatures, full-width forms
_MARKS = "".join(chr(p) for p in range(0x300, 0x370))  # combining marks, dropped


def _folds() -> dict[str, str]:
    """Lower-case letters of the folded blocks and the ASCII letters and digits left of them without their marks."""
    folds = dict(_UNDECOMPOSED)
    for first, last in _FOLDED_BLOCKS:
        for c in map(chr, range(first, last + 1)):
            plain = "".join(x for x in normalize("NFKD", c.lower()) if not combining(x))
            if c == c.lower() and c not in folds and plain != c and plain.isascii() and plain.isalnum():
                folds[c] = plain
    return folds


_FOLDS = _folds()
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def _java(blocks: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in blocks)


_TOKEN = rf"[{_java(_SINGLE)}]|[{_java(_KATAKANA)}]+|[\p{{L}}\p{{N}}\p{{M}}&&[^{_java(_SINGLE + _KATAKANA)}]]+"


def folded(c) -> Column:
    """Lower case, without accents and marks; letters that stand for two, and full-width forms, as ASCII. Kana and Han stay."""
    low = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "".join(_ONE) + _MARKS, "".join(_ONE.values()))
    long = low
    for letter, plain in _MORE.items():
        long = F.replace(long, F.lit(letter), F.lit(plain))
    return F.when(low.rlike(f"[{''.join(_MORE)}]"), long).otherwise(low)


def search_tokens(*cs) -> Column:
    """Tokens of the given columns in order: folded words, Han and hiragana characters one by one, katakana runs."""
    return F.concat(*[F.regexp_extract_all(folded(c), F.lit(_TOKEN), F.lit(0)) for c in cs])


def analysed(term: str | None) -> list[str]:
    """The tokens of a search term, as ``search_tokens`` makes them of a title."""
    text = (term or "").lower().translate(str.maketrans({c: None for c in _MARKS} | _FOLDS))
    tokens: list[str] = []
    for kind, chars in groupby(text, _token_class):
        run = "".join(chars)
        tokens += list(run) if kind == "single" else [run] if kind else []
    return tokens


def _token_class(char: str) -> str | None:
    """Whether a character is a token, or part of a katakana run or of a word; None for what parts tokens."""
    for kind, blocks in (("single", _SINGLE), ("katakana", _KATAKANA)):
        if any(first <= ord(char) <= last for first, last in blocks):
            return kind
    return "word" if category(char)[0] in "LNM" else None
