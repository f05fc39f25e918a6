"""Examples for names, titles, cells, periods and vectors."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfgraph.functions import names as N, nodes as Nd, scoring as Sc, titles as Ti, vectors as V
from shelfgraph.operators.search import query_terms, term_edits
from shelfgraph.sources import cells


def one(value, fn, text):
    return value(fn("x"), "x string", text)


@pytest.mark.parametrize("raw, want", [
    ("[著]尾田栄一郎", "尾田栄一郎"), ("[[著]]尾田栄一郎", "尾田栄一郎"), ("[原作] A [作画]", "A"), ("　A　", "A"), ("", ""), (None, ""),
])
def test_creator(value, raw, want):
    assert one(value, N.normalize_creator, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("集英社　∥　シュウエイシャ", "集英社"), ("集英社（発売）", "集英社"), ("集英社（発売）　∥　シュウエイシャ", "集英社"), ("A (x) B", "A  B"), (None, ""),
])
def test_publisher(value, raw, want):
    assert one(value, N.normalize_publisher, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("岸本斉史, 江坂純", ["岸本斉史", "江坂純"]), ("[原作]岸本斉史, ひなたしょう", ["[原作]岸本斉史", "[原作]ひなたしょう"]),
    ("作者A・作者B", ["作者A", "作者B"]), ("ジャンプ・コミック出版", ["ジャンプ・コミック出版"]), ("とても長い名前の人です・B", ["とても長い名前の人です・B"]),
    ("a、b,,c", ["a", "b", "c"]), ("a・b, c", ["a・b", "c"]), ("", []), (None, []), ("[著]", []),
])
def test_split(value, raw, want):
    assert one(value, N.split_creators, raw) == want


@pytest.mark.parametrize("raw, want", [("X 第3巻", "X"), ("A = B", "A"), ("X vol. 3 (2)", "X"), ("X その2 その3", "X"), ("X 12", "X"), ("12", ""),
                                       ("X 第１２巻", "X"), ("", ""), (None, None), ("X Volume 7", "X"), ("X 巻5 9", "X 巻5")])
def test_base_title(value, raw, want):
    assert one(value, Ti.base_title, raw) == want


def test_base_title_equals_repeated_removal(spark):
    """The single pattern removes what stripping one mark at a time removes."""
    import random

    rng = random.Random(7)
    bits = ["x", " ", "第3巻", "第4", "(12)", "vol. 4", "VOLUME 5", "巻6", "その7", "8", "(a)", "第巻"]
    titles = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    marks = [r"\s*第\d+巻?$", r"\s*\(\d+\)$", r"\s*vol\.\s*\d+$", r"\s*volume\s*\d+$", r"\s*巻\d+$", r"\s*その\d+$"]

    def slow(t):
        t = t.strip()
        while True:
            n = t
            for m in marks:
                n = re.sub(m, "", n, flags=re.I)
            if n == t:
                return re.sub(r"\s*\d+$", "", t).strip()
            t = n

    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", Ti.base_title("t").alias("b")).collect()
    assert [(r.t, r.b) for r in rows if r.b != slow(r.t)] == []


@pytest.mark.parametrize("title, volume, want", [("X 7", None, 7), ("X 7", "3", 3), ("X", " 4 ", 4), ("X ７", "a", 7), ("X", None, None), ("X 7 ", "", 7),
                                                 ("9" * 30, None, None)])
def test_volume(value, title, volume, want):
    assert value(Ti.volume_number("t", "v"), "t string, v string", title, volume) == want


@pytest.mark.parametrize("raw, start, end", [
    ("Aug 25, 1989 to ?", 1989, 2020), ("2001", None, 2020), ("Jan 1, 1990 to Feb 2, 1995", 1990, 1995), (None, None, 2020), ("", None, 2020),
    ("Jan 1, 1990", 1990, 2020), ("Jan 1, 1990 to 1995", 1990, 2020), ("1989 to Feb 2, 1995", None, 1995),
])
def test_years(value, raw, start, end):
    assert one(value, Sc.start_year, raw) == start
    assert value(Sc.end_year("x", 2020), "x string", raw) == end


@pytest.mark.parametrize("a, b, want", [((1990, 1999), (1995, 2004), 5 / 15), ((1990, 1991), (1995, 1996), 0.0), ((None, 1991), (1995, 1996), 0.0),
                                        ((1990, 1990), (1990, 1990), 1.0), ((1990, None), (1990, 1991), None)])
def test_jaccard(value, a, b, want):
    got = value(Sc.period_jaccard("a", "b", "c", "d"), "a int, b int, c int, d int", *a, *b)
    assert got == want if want is None else got == pytest.approx(want)


def test_demographic(value):
    s = "a array<string>, b array<string>"
    assert value(Sc.demographic_score("a", "b"), s, ["x", "y"], ["x", "y"]) == 2
    assert value(Sc.demographic_score("a", "b"), s, ["x", "y"], ["y", "x"]) == 1  # order matters for a full match
    assert value(Sc.demographic_score("a", "b"), s, [], []) == 0
    assert value(Sc.themes_overlap("a", "b"), s, ["x", "x", "z"], ["x"]) == 2
    assert value(Sc.themes_ratio("a", "b"), s, None, ["x"]) == 0.0


def test_names_of_authors(value):
    assert one(value, N.author_name, "[著]手塚・編集") == "手塚"
    assert one(value, N.author_name, "[著]") == "[著]"
    assert one(value, N.canonical_key, "テヅカ Osamu（作）") == "てづか osamu"
    assert one(value, N.canonical_key, "（作）") is None
    assert one(value, N.role_aware_score, "[著]手塚") == 9
    assert one(value, N.role_aware_score, "[監修]テヅカ") == 2
    assert one(value, N.is_editorial, "ジャンプ編集部") is True
    assert one(value, N.is_editorial, None) is False


def test_first_appearance(value):
    assert one(value, N.first_appearance_magazines, "「前」初出：「週刊少年ジャンプ」2号、「A」「別冊 マーガレット 」") == ["週刊少年ジャンプ", "別冊 マーガレット"]
    assert one(value, N.first_appearance_magazines, "「前」") == []
    assert one(value, N.first_appearance_magazines, None) == []


def test_cells(value):
    assert one(value, cells.list_cell, '["A","B"]') == ["A", "B"]
    assert one(value, cells.list_cell, '[""A"",""B""]') == ["A", "B"]
    assert one(value, cells.list_cell, "['A', 'B']") == ["A", "B"]
    assert one(value, cells.list_cell, "A") is None
    assert one(value, cells.loose_list_cell, "[A, 'B']") == ["A", "B"]
    assert one(value, cells.split_cell, " a;b, a,,") == ["a", "b"]
    assert value(cells.clean_entries("x"), "x array<string>", [" a  b ", "N/A", "?", None, "a b"]) == ["a b", "?"]
    kinds = {"": None, "?": None, "5": "int", "-5": "int", "9.47": "float", "1e3": "float", "[1]": "list", '{"a":1}': "object", "x": "text", "{x": "text"}
    for raw, kind in kinds.items():
        assert one(value, cells.typed_cell, raw)["kind"] == kind, raw


def test_labels_and_content(value):
    s = "a array<string>, b string"
    assert value(Nd.mentions("hentai", "a", "b"), s, ["Action", "Hentai"], None) is True
    assert value(Nd.mentions("hentai", "a", "b"), s, [], "soft-HENTAI") is True
    assert value(Nd.mentions("hentai", "a", "b"), s, ["Action"], "hentai") is False  # the list is asked first
    assert value(Nd.infer_type("a"), s, ["Author", "Work"], None) == "work"
    assert value(Nd.infer_type("a"), s, ["Studio"], None) == "studio"
    assert value(Nd.infer_type("a"), s, [], None) == "unknown"
    assert one(value, lambda c: Nd.derive_label("work", title_name=c), "  ") == "Work"


def test_output_form(spark):
    rows = spark.createDataFrame([("w1", "A", True, "7", ["集英社（発売）", "集英社", ""]), ("w2", "B", False, "7", None)],
                                 "id string, label string, is_series boolean, volume string, publishers array<string>")
    out = {r.id: r for r in Nd.output_works(rows).collect()}
    assert (out["w1"].volume, out["w2"].volume) == ("1", "7")
    assert out["w1"].publishers == ["集英社"] and out["w1"].total_volumes == 1 and out["w1"].series_volumes == "7"


def test_query_terms():
    assert query_terms("One Piece") == [("one", 0), ("piece", 1)]
    assert query_terms("  ") == [] and query_terms(None) == []
    assert query_terms("a+b~") == [("a", 0), ("b", 0)] and query_terms("a+bc~") == [("a", 0), ("bc", 1)]


def test_similarity(value):
    s = "a string, b string"
    assert value(Ti.levenshtein_similarity("a", "b"), s, "", "") == 1.0
    assert value(Ti.levenshtein_similarity("a", "b"), s, "abcd", "abce") == 0.75


def test_tokens(value):
    assert one(value, Ti.search_tokens, "Pokémon: Ōban 2") == ["pokemon", "oban", "2"]
    assert one(value, Ti.search_tokens, "進撃の巨人 x ワンピース3") == ["進", "撃", "の", "巨", "人", "x", "ワンピース", "3"]
    assert one(value, Ti.search_tokens, "Strauß ﬁn ＡＢ１ Ấn e\u0301t œuvre Łódź ĳ 々𠀋") == [
        "strauss", "fin", "ab1", "an", "et", "oeuvre", "lodz", "ij", "々", "𠀋"]
    assert one(value, Ti.search_tokens, "猫") == ["猫"]
    assert one(value, Ti.search_tokens, None) == []


def test_hash_embedding(value):
    text, dims = "作品 A", 1536
    digits = "".join(hashlib.sha256(text.encode() + str(i).encode()).hexdigest() for i in range(6))
    want = [int(digits[i % len(digits)], 16) / 15 - 0.5 + (i % 100) / 10000 - 0.005 for i in range(dims)]
    assert value(V.hash_embedding("x", dims), "x string", text) == pytest.approx(want)


def test_vectors(value, spark):
    s = "a array<float>, b array<float>"
    assert value(V.cosine("a", "b"), s, [1.0, 0.0], [1.0, 0.0]) == 1.0
    assert value(V.cosine("a", "b"), s, [0.0, 0.0], [1.0, 0.0]) is None
    assert value(V.cosine("a", "b"), s, [1.0], [1.0, 0.0]) is None
    assert value(V.truncate("a", 1), s, [3.0, 4.0], None) == [3.0]
    assert value(V.fit("a", 3), s, [3.0, 4.0], None) == [3.0, 4.0, 0.0]
    with pytest.raises(ValueError):
        V.truncate("a", 0)
    with pytest.raises(Exception, match="cannot take 5"):
        value(V.truncate("a", 5), s, [3.0, 4.0], None)


def test_terms_of_a_column_equal_those_of_a_text(spark):
    terms = ["One Piece", "dr.stone", "Café 鋼の", "鋼の x", "x", "ワンピース!!", " ", "a bb bb", "ＡＢ ab", None, "İstanbul Strauß", "らーめん ｶﾅ", "한국 1",
             "กขค ab", "e\u0301t", "ẞ", "\U0002000b々〇 ﬀ"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", term_edits("t").alias("e")).collect()
    for r in rows:
        assert sorted(tuple(e) for e in r.e) == sorted(query_terms(r.t)), r.t


def test_hash_embeddings_are_those_of_the_formula(spark):
    """All 1536 components, in batches of several sizes, without array lambdas, which took a millisecond or more a row; null stays null."""
    texts = [f"text {i} \u6d77" if i % 7 else None for i in range(2500)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    made = rows.select("i", V.hash_embedding("t").alias("v"))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = dict(map(tuple, made.collect()))
    for i in (0, 1, 2, 7, 1234, 2499, 2500):
        if texts[i] is None:
            assert got[i] is None
            continue
        digits = "".join(hashlib.sha256((texts[i] + str(d)).encode()).hexdigest() for d in range(6))
        assert got[i] == [int(digits[k % 384], 16) / 15.0 - 0.5 + ((k % 100) / 10000.0 - 0.005) for k in range(1536)]
    assert len(got) == 2501 and sum(v is None for v in got.values()) == 358
