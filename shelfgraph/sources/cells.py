"""CSV and JSON cells: missing tokens, lenient lists, typed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.text import ascii_digits, blank_to_null, col, collapse_spaces, strip
from shelfgraph.functions.titles import linkage_title

# Fixed values.
MISSING_CELLS = ["", "unknown", "n/a", "na", "null", "none", "?"]
MISSING_ENTRIES = ["", "unknown", "n/a", "na", "null", "none"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text; quoted cells may span lines and double their quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def cell(c) -> Column:
    """Trimmed cell, null for a missing-value token."""
    text = strip(c)
    return F.when(~F.lower(text).isin(MISSING_CELLS), text)


def _single_quotes(text) -> Column:
    """Cell text with doubled quotes made single."""
    return F.replace(text, F.lit('""'), F.lit('"'))


def literal_to_json(text) -> Column:
    """A list or object written with single quotes, None, True and False, as JSON; quoted text keeps its words."""
    parts = F.regexp_extract_all(text, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+"""), F.lit(0))

    def rewritten(part: Column) -> Column:
        inner = F.replace(F.substring(part, F.lit(2), F.length(part) - 2), F.lit("\\'"), F.lit("'"))
        quoted = F.concat(F.lit('"'), F.regexp_replace(inner, r'(?<!\\)"', r'\\"'), F.lit('"'))
        bare = part
        for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
            bare = F.regexp_replace(bare, rf"\b{word}\b", json)
        return F.when(part.startswith("'"), quoted).when(part.startswith('"'), part).otherwise(bare)

    return F.array_join(F.transform(parts, rewritten), "")


def list_cell(c) -> Column:
    """List in a cell: JSON with plain or doubled quotes, or a literal with single quotes and None; null when it is none."""
    text = strip(c)
    single = _single_quotes(text)
    parsed = F.coalesce(F.from_json(single, "array<string>"), F.from_json(literal_to_json(single), "array<string>"))
    return F.when(text.startswith("["), parsed)


def object_cell(c) -> Column:
    """JSON text of an object in a cell, written as JSON or as a literal; null when it is none."""
    text = strip(c)
    single = _single_quotes(text)
    literal = literal_to_json(single)
    found = F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in (text, single, literal)])
    return F.when(text.startswith("{"), found)


def loose_list_cell(c) -> Column:
    """As ``list_cell``, falling back to the comma-separated text between the brackets."""
    bare = F.regexp_replace(strip(c), r"^\[|\]$", "")
    parts = F.transform(F.split(bare, ","), lambda p: F.regexp_replace(strip(p), r"""^['"]+|['"]+$""", ""))
    return F.coalesce(list_cell(c), F.filter(parts, lambda p: p != ""))


def number_cell(c) -> tuple[Column, Column]:
    """A cell as whole number and as any number; null where it is none. Full-width digits count, and single underscores between the digits of a float."""
    text = ascii_digits(cell(c))
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    # The cast alone would also take the suffixes of number literals, as in 3D and 5f.
    digits = r"\d+(_\d+)*"
    written = text.rlike(rf"(?i)^[+-]?({digits}\.?({digits})?(e[+-]?{digits})?|\.{digits}(e[+-]?{digits})?|inf|infinity|nan)$")
    return whole, F.when(written, F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def typed_cell(c) -> Column:
    """Kind and value of a cell as one struct: list, object, int, float, text, or all null when missing.

    An object keeps its JSON text.
    """
    text, items, json = cell(c), list_cell(c), object_cell(c)
    whole, number = number_cell(c)
    kind = (
        F.when(text.isNull(), F.lit(None).cast("string")).when(items.isNotNull(), "list").when(json.isNotNull(), "object")
        .when(whole.isNotNull(), "int").when(number.isNotNull(), "float").otherwise("text")
    )
    return F.struct(
        kind.alias("kind"), F.when(kind == "list", items).alias("items"), F.when(kind == "int", whole).alias("whole"),
        F.when(kind.isin("int", "float"), number).alias("number"), F.when(kind == "object", json).when(kind == "text", text).alias("text"),
    )


def typed_rows(df: DataFrame, id_: str, types: dict[str, str]) -> DataFrame:
    """Rows with an id and columns of declared types (list, int, float, text); other columns go to ``extra``."""

    def typed(name: str, kind: str) -> Column:
        if kind == "list":
            return list_cell(name)
        if kind == "int":
            return number_cell(name)[0]
        return number_cell(name)[1] if kind == "float" else cell(name)

    rest = [c for c in df.columns if c != id_ and c not in types]
    pairs = [x for c in rest for x in (F.lit(c), cell(c))]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    return df.filter(blank_to_null(id_).isNotNull()).select(
        strip(id_).alias("id"), *[typed(c, k).alias(c) for c, k in types.items()], extra.alias("extra")
    )


def clean_entries(values) -> Column:
    """Entries trimmed, inner spaces collapsed, missing tokens dropped, first of each kept in order."""
    tidy = F.transform(values, collapse_spaces)
    kept = F.filter(tidy, lambda s: s.isNotNull() & ~F.lower(s).isin(MISSING_ENTRIES))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def list_field(c) -> Column:
    return clean_entries(list_cell(c))


def split_cell(c) -> Column:
    """Distinct entries of a comma- or semicolon-separated cell."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), "[,;]"), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def relation_rows(df: DataFrame) -> DataFrame:
    """(work_id, title, authors, magazines) of the rows that name at least one of them."""
    rows = df.select(
        strip("id").alias("work_id"),
        F.nullif(strip(F.when(F.coalesce("title_name", F.lit("")) != "", F.col("title_name")).otherwise(F.col("english_name"))),
                 F.lit("")).alias("title"),
        list_field("authors").alias("authors"), list_field("serialization").alias("magazines"),
    )
    return rows.filter((F.col("work_id") != "") & ((F.size("authors") > 0) | (F.size("magazines") > 0)))


def synopsis_rows(df: DataFrame) -> DataFrame:
    """Rows with a Japanese title and a synopsis; the title in its linkage form."""
    both = (F.coalesce("title_japanese", F.lit("")) != "") & (F.coalesce("synopsis", F.lit("")) != "")
    rest = [c for c in df.columns if c not in ("title_japanese", "synopsis")]
    return df.filter(both).select(*rest, linkage_title("title_japanese").alias("title"), strip("synopsis").alias("synopsis"))
