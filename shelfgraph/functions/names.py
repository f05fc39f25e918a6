"""Names of creators, publishers, magazines and brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.text import col, strip, to_hiragana

# Fixed values.
COMPANY_WORDS = ["編集部", "出版", "社", "プロダクション", "スタジオ"]
EDITORIAL_MARK = "編集"  # every editorial-department keyword contains it
AUTHOR_ROLES = ["[著]", "[原作]", "[漫画]", "[作]", "[作画]"]
MAX_DOT_PART = 8
FIRST_APPEARANCE = "初出："

_ROLE = r"\[+[^\]]*\]+"
_KANJI = r"[\x{4e00}-\x{9fff}]"
_LATIN = r"[A-Za-z]"
_KATAKANA = r"[\x{30a0}-\x{30ff}]"


def normalize_creator(c) -> Column:
    """Creator name without any ``[role]`` marks; null becomes ''."""
    return F.coalesce(strip(F.regexp_replace(strip(c), _ROLE, "")), F.lit(""))


def normalize_publisher(c) -> Column:
    """Publisher name without the reading after ``∥`` and without bracketed notes; null becomes ''."""
    no_reading = F.regexp_replace(strip(c), "　*∥.*$", "")
    return F.coalesce(strip(F.regexp_replace(no_reading, r"[（(][^）)]*[）)]", "")), F.lit(""))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def _looks_like_person(part: Column) -> Column:
    company = F.lit(False)
    for word in COMPANY_WORDS:
        company = company | part.contains(word)
    return (F.length(part) <= MAX_DOT_PART) & ~company


def split_creators(c) -> Column:
    """Array of creators; a leading ``[role]`` is put back on each.

    Commas always separate. A middle dot separates only when it is the single delimiter and every
    part is short and names no company.
    """
    whole = F.coalesce(strip(c), F.lit(""))
    role = F.regexp_extract(whole, f"^({_ROLE})", 1)
    by_comma = _pieces(F.regexp_replace(whole, f"^{_ROLE}", ""), "[,、]")
    by_dot = _pieces(F.get(by_comma, F.lit(0)), "・")
    people = (F.size(by_comma) == 1) & (F.size(by_dot) > 1) & F.forall(by_dot, _looks_like_person)
    names = F.when(people, by_dot).otherwise(by_comma)
    return F.transform(names, lambda n: F.concat(role, n))


def split_and_normalize_creators(c) -> Column:
    return F.transform(split_creators(c), normalize_creator)


def entity_id(name, entity_type: str) -> Column:
    """``{type}_{digest}``; a digest keeps ids equal between runs and machines, '' stays ''."""
    n = F.coalesce(col(name), F.lit(""))
    return F.when(n == "", F.lit("")).otherwise(F.concat(F.lit(entity_type + "_"), F.sha2(n, 256)))


def is_editorial(c) -> Column:
    return F.coalesce(col(c).contains(EDITORIAL_MARK), F.lit(False))


def author_name(c) -> Column:
    """Name without a leading ``[role]``, cut at the first middle dot; the input when nothing is left."""
    bare = strip(F.regexp_replace(col(c), r"^\[.*?\]", ""))
    cut = strip(F.substring_index(bare, "・", 1))
    return F.when(cut == "", col(c)).otherwise(cut)


def canonical_key(c) -> Column:
    """Merge key: text before a bracket, in hiragana, lower case; null when empty."""
    plain = strip(F.substring_index(F.substring_index(col(c), "(", 1), "（", 1))
    return F.nullif(F.lower(to_hiragana(plain)), F.lit(""))


def with_canonical_key(df: DataFrame, name: str, readings: DataFrame | None = None,
                       out: str = "key") -> DataFrame:
    """Add the merge key; ``readings(surface, reading)`` maps names written in kanji to their kana.

    ``readings`` needs one row per surface. It is a plain join: AQE broadcasts it only when its
    measured size is below the broadcast threshold.
    """
    if readings is None:
        return df.withColumn(out, canonical_key(name))
    known = readings.select(F.col("surface").alias("_surface"), F.col("reading").alias("_reading"))
    base = strip(F.substring_index(F.substring_index(col(name), "(", 1), "（", 1))
    return (
        df.withColumn("_base", base)
        .join(known, F.col("_base") == F.col("_surface"), "left")
        .withColumn(out, canonical_key(F.coalesce("_reading", "_base")))
        .drop("_base", "_surface", "_reading")
    )


def script_priority(c) -> Column:
    """4 kanji, 3 latin, 2 katakana, 1 anything else."""
    return (
        F.when(col(c).rlike(_KANJI), 4).when(col(c).rlike(_LATIN), 3).when(col(c).rlike(_KATAKANA), 2).otherwise(1)
    )


def role_aware_score(c) -> Column:
    """Script priority of the bare name, plus 5 when the name carries an author role."""
    role = F.regexp_extract(col(c), r"^(\[[^\]]*\])", 1)
    return script_priority(author_name(c)) + F.when(role.isin(AUTHOR_ROLES), 5).otherwise(0)


def first_appearance_magazines(c) -> Column:
    """Magazine names quoted as 「…」 after the first-appearance mark, longer than one character."""
    tail = F.when(
        F.locate(FIRST_APPEARANCE, col(c)) > 0,
        F.substring(col(c), F.locate(FIRST_APPEARANCE, col(c)) + F.lit(len(FIRST_APPEARANCE)), F.length(col(c))),
    ).otherwise("")
    names = F.transform(F.regexp_extract_all(tail, F.lit("「([^」]+)」"), F.lit(1)), strip)
    return F.coalesce(F.filter(names, lambda n: F.length(n) > 1), F.array().cast("array<string>"))


def brand_head(c) -> Column:
    """Brand text before the first ``=``."""
    return strip(F.substring_index(col(c), "=", 1))


def translate_by(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Look ``column`` up in ``mapping(key, value)``; unknown values pass through.

    ``mapping`` needs one row per key.
    """
    m = mapping.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return (
        df.join(m, F.col(column) == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_value", F.col(column)))
        .drop("_key", "_value")
    )
