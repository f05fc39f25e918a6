"""Expansion, assembly, search and related works on a small graph."""

import pytest
from pyspark.sql import functions as F

from shelfgraph.graph import Graph, edge_id
from shelfgraph.operators import expand as X, filters as Fi, related as R, search as S, tabular as Tb

NODE = ("id string, type string, label string, work_id string, title_name string, english_name string, japanese_name string, title string, "
        "name string, genres array<string>, genre string, demographic array<string>, themes array<string>, members bigint, "
        "total_volumes int, publishing_date string, first_year int, last_year int")


@pytest.fixture
def graph(spark):
    def work(i, title, members, genres=("Action",), first=1990, last=1999, demo=("Shounen",), ja=None):
        date = f"Jan 01, {first} to Dec 31, {last}"
        return (f"w{i}", "work", title, str(i), title, None, ja, None, None, list(genres), None, list(demo), title.lower().split(), members, i, date, first, last)

    def other(id_, type_, name):
        return (id_, type_, name, None, None, None, None, None, name) + (None,) * 9

    nodes = [
        work(1, "One Piece", 100, ja="ワンピース"), work(2, "One Punch", 90, ("Hentai",)), work(3, "Naruto", 80, first=1995, last=2004),
        work(4, "One Pound", 100, demo=("Seinen",)), other("a1", "author", "Oda"), other("m1", "magazine", "Jump"), other("m2", "magazine", "Young Jump"),
        other("m3", "magazine", "Empty"), other("p1", "publisher", "Shueisha"),
    ]
    links = [("w1", "CREATED_BY", "a1"), ("w1", "PUBLISHED_IN", "m1"), ("w2", "PUBLISHED_IN", "m1"), ("w3", "PUBLISHED_IN", "m2"), ("w4", "PUBLISHED_IN", "m1"),
             ("m1", "PUBLISHED_BY", "p1"), ("m2", "PUBLISHED_BY", "p1"), ("w1", "RELATED_TO", "w2"), ("w4", "RELATED_TO", "w4")]
    edges = spark.createDataFrame(links, "src string, type string, dst string").withColumn("id", edge_id(F.col("src"), F.col("type"), F.col("dst")))
    return Graph(spark.createDataFrame(nodes, NODE), edges.select("id", "src", "dst", "type"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def links(df):
    return sorted((r.src, r.type, r.dst) for r in df.collect())


def test_simple_search(graph):
    found = S.search(graph, "one piece", 5)
    assert ids(found.nodes) == ["a1", "m1", "p1", "w1"]  # w2 is excluded content, and its edge goes with it
    assert links(found.edges) == [("m1", "PUBLISHED_BY", "p1"), ("w1", "CREATED_BY", "a1"), ("w1", "PUBLISHED_IN", "m1")]
    assert ids(S.search(graph, "one piece", 5, exclude=None).nodes) == ["a1", "m1", "p1", "w1", "w2"]
    found.release()


def test_search_order_and_limit(graph):
    assert [r.id for r in S.simple_hits(graph.of_type("work"), None, 3).collect()] == ["w1", "w4", "w2"]
    assert ids(S.search(graph, None, 1, exclude=None).of_type("work")) == ["w1", "w2"]


def test_excluded_after_limit(graph):
    """The limit is taken first: an excluded hit is not replaced, its neighbours stay."""
    assert ids(S.search(graph, "punch", 1).nodes) == ["m1", "p1", "w1"]


def test_self_loop_once(graph):
    found = R.work_subgraph(graph, "w4")
    assert links(found.edges) == [("w4", "PUBLISHED_IN", "m1"), ("w4", "RELATED_TO", "w4")]
    assert ids(found.nodes) == ["m1", "w4"]


def test_unknown_work(graph):
    found = R.work_subgraph(graph, "nope")
    assert found.nodes.count() == 0 and found.edges.count() == 0


def test_edges_have_their_ends(graph):
    found = S.search(graph, "one", 5, exclude=None)
    known = set(ids(found.nodes))
    assert all(s in known and d in known for s, _, d in links(found.edges))


def test_fuzzy_last_word(graph):
    hits = S.fulltext_hits(graph.of_type("work"), "pieca", 5)
    assert ids(hits) == ["w1"]
    assert ids(S.fulltext_hits(graph.of_type("work"), "narutoo x", 5)) == []  # only the last word is fuzzy
    assert ids(S.fulltext_hits(graph.of_type("work"), "narutoo", 5, "japanese")) == []


def test_ranked_drops_weak(graph):
    ranked = S.ranked_hits(graph.of_type("work"), "one piece", 5)
    rows = {r.id: r.final_score for r in ranked.collect()}
    assert rows["w1"] == pytest.approx(1.0) and all(v >= S.RANK_THRESHOLD for v in rows.values())


def test_cascade(graph):
    assert ids(S.cascade(graph, "piece", 3).of_type("work")) == ["w1"]
    assert ids(S.cascade(graph, "ンピ", 3).of_type("work")) == ["w1"]
    assert S.cascade(graph, "zzz", 3).nodes.count() == 0


def test_filters(graph):
    assert ids(Fi.search_with_types(graph, "x", ["author"], None).nodes) == ["a1"]
    assert Fi.search_with_types(graph, "x", ["author"], None).edges.count() == 9  # edges are not pruned
    assert Fi.search_with_types(graph, "  ").nodes.count() == 0
    assert ids(Fi.without_genre(graph.of_type("work"), "Hentai")) == ["w1", "w3", "w4"]
    assert ids(Fi.min_volumes(graph.of_type("work"), 3)) == ["w3", "w4"]
    assert len(ids(Fi.min_volumes(graph.of_type("work"), 99))) == 4


def test_magazine_works_by_reference(graph):
    found = R.magazine_works(graph, "m1", 5, "w1", 2020)
    rows = {r.id: (r.demo_score, r.themes_score, r.date_jaccard) for r in found.of_type("work").collect()}
    assert rows == {"w2": (2, 1, 1.0), "w4": (0, 1, 1.0)}
    assert R.magazine_works(graph, "m1", 5, "nope", 2020).nodes.count() == 0
    with pytest.raises(ValueError):
        R.magazine_works(graph, "m1", 5, "w1")


def test_magazines_graph_keeps_empty_magazines(graph):
    found = R.magazines_work_graph(graph, ["m1", "m3"], 1)
    assert ids(found.nodes) == ["m1", "m3", "w1"]
    assert R.magazines_work_graph(graph, [], 1).nodes.count() == 0
    assert R.magazines_work_graph(graph, ["m1"], 1, "nope", 2020).nodes.count() == 0


def test_publisher_magazines(graph):
    assert ids(R.publisher_magazines(graph, "p1", 5, "m1").nodes) == ["m2", "p1"]
    assert R.publisher_magazines(graph, "p9", 5).nodes.count() == 0


def test_same_publisher(graph):
    rows = R.same_publisher_other_magazines(graph, "w1", 2, limit=5).collect()
    assert [(r.id, r.magazine_id, r.overlap_years, r.period_gap) for r in rows] == [("w3", "m2", 5, 0)]
    assert rows[0].jaccard_similarity == pytest.approx(5 / 15)


def test_related_graphs_optional(graph):
    parts = R.related_graphs(graph, author_id="a1")
    assert parts["magazine_graph"] is None and ids(parts["author_graph"].nodes) == ["a1", "w1"]


def test_name_search(graph):
    found = S.name_search(graph, "jump", 10, 50)
    assert ids(found.nodes) == ["m1", "m2", "p1", "w1", "w2", "w3", "w4"]
    assert {t for _, t, _ in links(found.edges)} == {"published_in", "published_by"}


def test_merge_first_wins(graph):
    other = Graph(graph.of_type("work").withColumn("label", F.lit("second")), graph.edges)
    merged = X.merge_graphs(graph, other)
    assert merged.nodes.count() == 9 and merged.nodes.filter("label = 'second'").count() == 0 and merged.edges.count() == 9


ROWS = "uri string, title string, creator_uri string, creator_name string, genre string, publisher string, published_date string"


def test_repeated_rows_give_one_work(spark):
    rows = spark.createDataFrame([("u1", " T ", "c1", "C", "g", "P", "1990")] * 2 + [("u2", "T", "c2", "D", "g", "P", "1991"), ("u3", "", "c3", "E", "", "", "")], ROWS)
    g = Tb.works_and_authors(rows)
    assert ids(g.nodes) == ["c1", "u1"] and ids(g.edges) == ["c1-created-u1"]
    more = Tb.append_related(g, rows, "published_by")
    assert {r.type for r in more.nodes.collect()} == {"work", "author", "publisher"}
    assert len(ids(more.nodes)) == len(set(ids(more.nodes)))


def test_round_trip(graph, tmp_path, spark):
    graph.write(str(tmp_path / "g"))
    back = Graph.read(spark, str(tmp_path / "g"))
    assert ids(back.nodes) == ids(graph.nodes) and "type=author" in str([f for f in back.of_type("author").inputFiles()] or "type=author")


def test_query_and_titles_share_one_analyzer(graph):
    works = graph.of_type("work")
    assert S.query_terms("dr.stone") == [("dr", 0), ("stone", 1)] and S.query_terms("Café 鋼の") == [("cafe", 0), ("鋼", 0), ("の", 0)]
    assert S.query_terms("x") == [("x", 0)] and S.query_terms(" ") == [] and S.query_terms(None) == []
    for term in ("ワンピース", "ワンピーズ", "one.piece", "ONE-PIECÉ"):
        assert ids(S.fulltext_hits(works, term, 1)) == ["w1"], term
    assert ids(S.fulltext_hits(works, "鋼", 5)) == [] and ids(S.fulltext_hits(works, "y", 5)) == []
    assert ids(S.ranked_hits(works, "ワンピース", 5, "japanese")) == ["w1"]


def test_short_and_folded_words_are_found(graph, spark, tmp_path):
    rows = [("a", "鋼の錬金術師", None), ("b", "Strauß", "錬金"), ("c", "金の錬", None), ("d", "Strausz", None), ("e", "ワンピース", None)]
    works = spark.createDataFrame([(i, t, j, None, None) for i, t, j in rows], "id string, title_name string, japanese_name string, english_name string, title string")
    S.TokenIndex.of(works).write(str(tmp_path))
    for index in (None, S.TokenIndex.read(spark, str(tmp_path))):
        found = lambda term, **k: ids(S.fulltext_hits(works, term, 9, index=index, **k))
        assert found("鋼") == ["a"] and found("の") == ["a", "c"]
        assert found("strauss") == ["b", "d"] and found("STRAUẞ x") == ["b"]
        assert found("錬金") == ["a", "b", "c"] and found("錬金", phrase=True) == ["a", "b"]
        assert found("ß", phrase=True) == [] and found("鋼の錬金術師", phrase=True) == ["a"] and found("師錬", phrase=True) == []
        assert found("ワンピーズ") == ["e"] and found("zzz") == []


def test_words_one_edit_apart_share_a_variant():
    import random
    rng = random.Random(2)
    words = list({"".join(rng.choice("abc鋼") for _ in range(rng.randint(1, 5))) for _ in range(150)})

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for a in words:
        for b in words:
            if len(a) > 1 and len(b) > 1 and near(a, b):
                assert set(S.without_one(a)) & set(S.without_one(b)), (a, b)


def test_stored_tokens_give_the_same_scores(graph, spark, tmp_path):
    works = graph.of_type("work")
    S.TokenIndex.of(works).write(str(tmp_path))
    index = S.TokenIndex.read(spark, str(tmp_path))
    for term in ("one pieca", "ワンピース", "naruto", "nsruto", "x", "on", "oen"):
        plain, stored = (sorted((r.id, round(r.score, 9)) for r in S.fulltext_scores(works, term, index=i).collect()) for i in (None, index))
        assert plain == stored, term
        a, b = (sorted((r.id, round(r.final_score, 9)) for r in S.ranked_hits(works, term, 9, index=i).collect()) for i in (None, index))
        assert a == b, term
    plan = S.token_scores(index, S.query_terms("x narutoo"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,naruto)" in plan or "In(token, [" in plan
    plan = index.lookup(S.query_terms("x narutoo"))._jdf.queryExecution().executedPlan().toString()
    assert "In(variant, [" in plan


def test_lazy_index_reads_the_titles_once(graph):
    """Hits, their frequencies and the best score come out of one exchange of matching postings."""
    hits = S.ranked_hits(graph.of_type("work"), "one piece", 5)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") >= 1


def test_release_frees_everything(graph, spark):
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.catalog.clearCache()
    before = cached()
    for make in (
        lambda: S.search(graph, "one", 5), lambda: S.search(graph, "one", 5, mode="fulltext"), lambda: S.search(graph, "one", 5, mode="ranked"),
        lambda: S.cascade(graph, "piece", 3), lambda: S.cascade(graph, "zzz", 3), lambda: S.name_search(graph, "jump", 10, 50), lambda: R.work_subgraph(graph, "w4"),
        lambda: R.author_works(graph, "a1"), lambda: R.magazine_works(graph, "m1", 5, "w1", 2020), lambda: R.publisher_magazines(graph, "p1", 5),
    ):
        found = make()
        found.nodes.collect(), found.edges.collect()
        found.release()
        assert cached() == before


def test_stored_edges_are_read_by_either_end(graph, spark, tmp_path):
    graph.write(str(tmp_path), file_rows=2)
    stored = Graph.read(spark, str(tmp_path))
    for make in (lambda g: R.work_subgraph(g, "w1"), lambda g: R.work_subgraph(g, "a1"), lambda g: S.search(g, "one", 5, exclude=None), lambda g: S.name_search(g, "jump", 10, 50),
                 lambda g: R.author_works(g, "a1"), lambda g: R.magazine_works(g, "m1", 5), lambda g: R.work_subgraph(g, "nope")):
        a, b = make(graph), make(stored)
        assert ids(a.nodes) == ids(b.nodes)
        assert sorted(r.id for r in a.edges.collect()) == sorted(r.id for r in b.edges.collect())


def test_few_seeds_open_few_files(spark, tmp_path):
    """A graph with a hub: no file holds more than its share, and 50 seeds are read from the files whose range holds them."""
    links = [(f"w{i:05d}", "PUBLISHED_IN", "m1" if i % 3 else f"m{i}") for i in range(20_000)]
    edges = spark.createDataFrame(links, "src string, type string, dst string").withColumn("id", edge_id(F.col("src"), F.col("type"), F.col("dst")))
    kinds = edges.select(F.col("src").alias("id"), F.lit("work").alias("type")).union(edges.select("dst", F.lit("magazine")).distinct())
    Graph(kinds.withColumn("label", F.col("id")), edges.select("id", "src", "dst", "type")).write(str(tmp_path), file_rows=500)
    stored = Graph.read(spark, str(tmp_path))
    per_file = spark.read.parquet(f"{tmp_path}/edges_in/files").collect()
    assert max(r.rows for r in per_file) <= 500 and sum(r.rows for r in per_file) == 20_000
    assert sum(r.lo == r.hi == "m1" for r in per_file) > 20  # the hub is spread over many files
    seeds = [f"w{i:05d}" for i in range(0, 500, 10)]
    files = stored.by_src.files_of(seeds)
    assert 1 <= len(files) <= 3 and stored.by_src.files_of(["v", "x", "w00000x"]) == []
    found = X.incident_edges(stored, spark.createDataFrame([(s,) for s in seeds], "id string"))
    assert found.count() == 50 and len(found.filter("end = src").inputFiles()) <= 3
    assert X.incident_edges(stored, "m1").count() == sum(1 for x in links if x[2] == "m1")


def test_keyed_files_join_many_keys(spark, tmp_path, monkeypatch):
    from shelfgraph.sources import keyed_files as K
    rows = spark.createDataFrame([(f"k{i % 300}", i) for i in range(3000)], "k string, v int")
    stored = K.KeyedFiles.write(rows, str(tmp_path), "k", "v", file_rows=100)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(290, 310)] + [(None,)], "id string")
    want = sorted(tuple(r) for r in rows.collect() if r.k in {f"k{i}" for i in range(290, 310)})
    assert sorted(tuple(r) for r in stored.matching(keys).collect()) == want
    monkeypatch.setattr(K, "MOST_KEYS", 5)
    assert sorted(tuple(r) for r in stored.matching(keys).collect()) == want
    assert stored.having([]).count() == 0 and K.KeyedFiles.open(spark, str(tmp_path), "k").having(["k7"]).count() == 10
    assert K.KeyedFiles.write(rows.limit(0), f"{tmp_path}/none", "k").having(["k7"]).count() == 0


def test_substring_index_finds_what_the_scan_finds(graph, spark, tmp_path):
    from shelfgraph.operators.substrings import SubstringIndex
    graph.write(f"{tmp_path}/g", file_rows=2)
    stored = Graph.read(spark, f"{tmp_path}/g")
    index = SubstringIndex.write(stored.by_id, f"{tmp_path}/titles")
    works = graph.of_type("work")
    for term in ("one", "ONE P", "punch", "ンピース", "ピ", "e", "zzz", "one piece", "pie ce", "Naruto!", ""):
        for language in ("english", "japanese"):
            assert ids(S.simple_hits(works, term, 9, language)) == ids(S.simple_hits(stored.of_type("work"), term, 9, language, index)), term
        assert ids(S.name_search(graph, term, 10, 50).nodes) == ids(S.name_search(stored, term, 10, 50, index).nodes), term
    assert ids(S.simple_hits(works, None, 9)) == ids(S.simple_hits(works, None, 9, substrings=index))
    again = SubstringIndex.open(spark, f"{tmp_path}/titles", stored.by_id)
    assert ids(again.holding("punch")) == ["w2"] and len(again.holding("punch").inputFiles()) == 1
    assert again.candidates("pu") is None and again.candidates("zzz").count() == 0


def test_trigrams(spark):
    from shelfgraph.operators.substrings import trigrams
    got = spark.createDataFrame([("AbCa",), ("aaaa",), ("ab",), ("",), (None,), ("鋼の錬金",)], "t string").select(trigrams("t").alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bca"], ["aaa"], [], [], [], ["鋼の錬", "の錬金"]]


def test_same_publisher_search_options(graph):
    main = S.simple_hits(graph.of_type("work"), "one", 2)
    found = lambda **k: [r.id for r in R.search_with_same_publisher(main, graph, "w1", 20, **k).collect()]
    assert found() == ["w1", "w4", "w3"] and found(include_related=False) == ["w1", "w4"]
    assert found(sort_total_volumes="desc") == ["w4", "w3", "w1"] and found(sort_total_volumes="asc", min_total_volumes=3) == ["w3", "w4"]
    with pytest.raises(ValueError):
        found(sort_total_volumes="up")


def test_pairs_of_all_works_as_anchors(spark):
    """Interval-bucket joins: each pair once, as brute force and as the search for one anchor find it, without a nested loop."""
    import random
    rng = random.Random(9)
    years = {f"w{i}": (y := rng.choice([-3, 0, 1979, 1989, 1995, 2000]) + rng.randint(0, 6), y + rng.choice([0, 1, 4, 5, 17])) for i in range(60)} | {"w60": (None, 1990), "w61": (1990, None)}
    nodes = spark.createDataFrame([(i, "work", a, b) for i, (a, b) in years.items()], "id string, type string, first_year int, last_year int")
    links = {(w, "PUBLISHED_IN", f"m{rng.randint(0, 7)}") for w in years for _ in range(2)} | {(f"m{i}", "PUBLISHED_BY", f"p{i % 3}") for i in range(8)} | {("m1", "PUBLISHED_BY", "p0")}
    links |= {(w, "CREATED_BY", f"a{rng.randint(0, 20)}") for w in years}
    edges = spark.createDataFrame(sorted(links), "src string, type string, dst string").withColumn("id", edge_id(F.col("src"), F.col("type"), F.col("dst")))
    g = Graph(nodes, edges)
    full = {w: y for w, y in years.items() if None not in y}
    for window in (0, 2):
        want = sorted((a, b) for a, (f, l) in full.items() for b, (x, y) in full.items() if a != b and y >= f - window and x <= l + window)
        pairs = R.period_pairs(nodes, nodes, window)
        assert sorted((r.anchor_id, r.id) for r in pairs.collect()) == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    columns = ["id", "magazine_id", "publisher_id", "overlap_years", "period_gap", "jaccard_similarity", "same_author"]
    got = {}
    for r in R.same_publisher_pairs(g, nodes, 2).collect():
        got.setdefault(r.anchor_id, []).append(tuple(r[c] for c in columns))
    for anchor in ("w0", "w7", "w13", "w60"):
        one = sorted(tuple(r[c] for c in columns) for r in R.same_publisher_other_magazines(g, anchor, 2).collect())
        assert sorted(got.get(anchor, [])) == one
    best = {(r.anchor_id, r.id) for r in R.same_publisher_pairs(g, nodes, 2, k=3).collect()}
    assert {b for a, b in best if a == "w7"} == {r.id for r in R.same_publisher_other_magazines(g, "w7", 2, limit=3).collect()}
    most = {r.id: r.overlap_years for r in R.overlap_period_pairs(nodes, nodes, 4).filter("anchor_id = 'w3'").collect()}
    assert most == {r.id: r.overlap_years for r in R.overlap_period_works(g, "w3", 4).collect()}


def test_best_overlaps_meet_by_period(spark):
    """The works with the most shared years come from the first ids of each period; no pair of works is made before the cut."""
    import random
    import re
    rng = random.Random(4)
    years = {f"w{i:04d}": (y := rng.randint(1990, 1996), y + rng.randint(0, 3)) for i in range(400)} | {"gone": (1999, 1990), "open": (1991, None)}
    nodes = spark.createDataFrame([(i, "work", a, b) for i, (a, b) in years.items()], "id string, type string, first_year int, last_year int")
    found = R.overlap_period_pairs(nodes, nodes.filter("id <= 'w0050' or id = 'gone'"), 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.anchor_id, []).append((-r.overlap_years, r.id))
    full = {w: y for w, y in years.items() if None not in y and y[0] <= y[1]}
    want = {}
    for a in [w for w in full if w <= "w0050"]:
        shared = sorted((-(min(full[a][1], y[1]) - max(full[a][0], y[0]) + 1), w) for w, y in full.items() if w != a)
        want[a] = [s for s in shared if s[0] < 0][:3]
    assert {a: sorted(v) for a, v in got.items()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[first_year#\d+, last_year#\d+\]", plan)  # anchors meet the best of their period


def test_pairs_at_a_publisher_are_not_shuffled(spark):
    """Each pair of works is told from the two lists: a pair at several publishers counts once, and no exchange or distinct follows the join."""
    rows = [(f"w{i}", "work", 1990, 1991) for i in range(12)]
    nodes = spark.createDataFrame(rows, "id string, type string, first_year int, last_year int")
    links = [(f"w{i}", "PUBLISHED_IN", f"m{j}") for i in range(12) for j in range(6) if (i + j) % 4] + [(f"m{j}", "PUBLISHED_BY", f"p{j % 3}") for j in range(6)]
    edges = spark.createDataFrame(links, "src string, type string, dst string").withColumn("id", edge_id(F.col("src"), F.col("type"), F.col("dst")))
    pairs = R.same_publisher_pairs(Graph(nodes, edges), nodes, 0).select("anchor_id", "id", "magazine_id")
    mags = {w: {d for s, t, d in links if s == w and t == "PUBLISHED_IN"} for w, *_ in rows}
    by = {s: d for s, t, d in links if t == "PUBLISHED_BY"}
    want = {(a, b): min(c) for a in mags for b in mags if a != b and (c := {m for m in mags[b] - mags[a] if by[m] in {by[x] for x in mags[a]}})}
    got = pairs.collect()
    assert len(got) == len(want) and {(r.anchor_id, r.id): r.magazine_id for r in got} == want
    top = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top and "Sort" not in top


def test_stored_edges_leave_out_made_ids(spark, tmp_path):
    """An id that is its edge's digest is not stored; other ids, null ones too, come back as they were."""
    rows = [("w1", "CREATED_BY", "a1", None), ("w1", "CREATED_BY", "a2", "own"), ("w2", "PUBLISHED_IN", "m1", "made"), (None, "CREATED_BY", "a3", "made")]
    edges = spark.createDataFrame(rows, "src string, type string, dst string, id string")
    edges = edges.withColumn("id", F.when(F.col("id") == "made", edge_id("src", "type", "dst")).otherwise(F.col("id")))
    nodes = spark.createDataFrame([("w1", "work", "x")], "id string, type string, label string")
    Graph(nodes, edges).write(str(tmp_path))
    key = lambda df: sorted(map(str, df.select("src", "type", "dst", "id").collect()))
    stored = Graph.read(spark, str(tmp_path))
    assert key(stored.edges) == key(edges) == key(stored.by_dst.all())
    assert stored.edges.columns == edges.columns
    for name in ("edges", "edges_in"):
        assert {r.id for r in spark.read.parquet(f"{tmp_path}/{name}/rows").collect()} == {None, "own"}


def test_texts_of_many_rows_are_indexed_once(spark, tmp_path):
    from shelfgraph.operators.substrings import SubstringIndex
    rows = spark.createDataFrame([(f"work:{i}", kind, f"Name {i % 3}") for i in range(300) for kind in ("creator", "magazine")] + [("work:x", "creator", None)],
                                 "work_id string, kind string, name string")
    index = SubstringIndex.write(rows, str(tmp_path), by_text="name")
    assert index.postings.all().count() == 3 * 4  # four trigrams of three names
    found = SubstringIndex.open(spark, str(tmp_path), by_text="name").holding("ame 1")
    assert sorted(map(tuple, found.select("work_id", "kind", "name").collect())) == sorted(tuple(r) for r in rows.filter("name = 'Name 1'").collect())
    assert index.holding("zzz").count() == 0 and index.holding("1").count() == 601


def test_queries_store_only_what_they_read(spark, monkeypatch):
    from shelfgraph.plans import binding, all_queries
    monkeypatch.setattr(binding, "_STORED", {})
    sf = "/root/testdata/sf0.001"
    all_queries().QUERIES["q2_stored_hits"](spark, sf).collect()
    kept = binding.stored_catalogue(spark, sf)
    assert {"nodes", "tokens"} <= set(vars(kept)) and not {"graph", "titles", "credits"} & set(vars(kept))


def test_view_finds_its_works_first(spark):
    """A limited lookup of the view gives the rows of the whole table, and asks works and credits for few ids; ids repeat and are null."""
    works = spark.createDataFrame([(None if i == 3 else f"w{i % 50:02d}", f"red {i % 7}" if i % 3 else "blue", "g", "1999-01-01") for i in range(60)],
                                  "id string, title_name string, genre string, first_published string")
    credits = spark.createDataFrame([(f"w{i % 50:02d}", kind, f"{kind} {i}") for i in range(100) for kind in ("creator", "publisher")], "work_id string, kind string, name string")
    asked = []

    def of(rows, key):
        def made(ids):
            asked.append(ids)
            return rows if ids is None else rows.join(ids.select(F.col("id").alias("_id")), F.col(key).eqNullSafe(F.col("_id")), "left_semi")
        return made

    view = Tb.CatalogueView(of(works, "id"), of(credits, "work_id"))
    for limit in (1, 7, 25, 500):
        asked.clear()
        found = Tb.rows_by_title(view, "RED", limit)
        key = lambda df: sorted(map(str, df.select("uri", "creator_uri", "publisher").collect()))
        assert key(found) == key(Tb.rows_by_title(Tb.catalogue_rows(works, credits), "RED", limit))
        assert [a is None for a in asked] == [True, False, False] and asked[1].count() <= limit
    assert key(view.rows()) == key(Tb.catalogue_rows(works, credits))


def test_bound_works_and_credits_of_few_ids(spark, tmp_path):
    """Rows of asked works are those of the whole tables, and lines of other works leave before they are grouped."""
    from shelfgraph.plans import binding as Bi

    sf = str(tmp_path)
    spark.range(40).selectExpr("id l_orderkey", "id % 13 l_partkey", "id % 3 l_suppkey", "double(id) l_extendedprice", "timestamp_ntz'1995-01-01' l_shipdate").write.parquet(f"{sf}/lineitem.parquet")
    spark.range(20).selectExpr("id p_partkey", "'red ring' p_name", "'B' p_brand", "'PROMO' p_type", "1 p_size", "9.0D p_retailprice").write.parquet(f"{sf}/part.parquet")
    spark.range(3).selectExpr("id s_suppkey", "concat('S', id) s_name", "int(id) s_nationkey").write.parquet(f"{sf}/supplier.parquet")
    spark.range(3).selectExpr("int(id) n_nationkey", "concat('N', id) n_name", "0 n_regionkey").write.parquet(f"{sf}/nation.parquet")
    spark.sql("select 0 r_regionkey, 'R' r_name").write.parquet(f"{sf}/region.parquet")
    ids = spark.createDataFrame([("work:7",), ("work:11",), ("work:none",)], "id string")
    for made, key in ((Bi.works, "id"), (Bi.credits, "work_id")):
        few, whole = made(spark, sf, ids), made(spark, sf)
        want = whole.filter(F.col(key).isin("work:7", "work:11"))
        assert sorted(map(str, few.collect())) == sorted(map(str, want.collect())) != []
    plan = Bi.works(spark, sf, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") < plan.rindex("LeftSemi")


def test_merged_edges_keep_their_ids(spark):
    """Ids that are digests are left out of the shuffle and come back; own ids, repeated ids and null ends stay as they are."""
    rows = [("w1", "a1", "CREATED_BY"), ("w2", "a1", "CREATED_BY"), (None, "a2", "CREATED_BY"), ("w3", None, "X")]
    made = spark.createDataFrame(rows, "src string, dst string, type string").withColumn("id", edge_id("src", "type", "dst"))
    own = spark.createDataFrame([("e1", "w9", "a9", "X"), ("e1", "w8", "a8", "X"), ("e2", "w1", "a1", "CREATED_BY"), (None, "w1", "a1", "CREATED_BY")], "id string, src string, dst string, type string")
    moved = made.filter("src = 'w1'").withColumn("src", F.lit("w5"))  # another edge under the id of w1's
    none = spark.createDataFrame([("n", "work", "l")], "id string, type string, label string")
    first = moved.withColumn("part", F.lit("first"))
    found = X.assemble([none], [first, made.unionByName(own).withColumn("part", F.lit("second"))]).edges
    ids = {r.src: r.id for r in made.collect()}
    want = [(ids["w1"], "w5", "a1", "first"), (ids["w2"], "w2", "a1", "second"), (ids[None], None, "a2", "second"), (ids["w3"], "w3", None, "second"),
            ("e1", "w8", "a8", "second"), ("e2", "w1", "a1", "second"), (None, "w1", "a1", "second")]
    assert sorted(map(str, [(r.id, r.src, r.dst, r.part) for r in found.collect()])) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan[plan.index("RepartitionByExpression"):]  # the id is taken off below the shuffle


def test_author_works_group_the_lines_of_few_works(graph):
    """Titles are ranked without the columns that works are joined for; a derived graph makes the found nodes only."""
    asked = []

    def few(ids):
        asked.append(ids.count())
        return graph.nodes.join(ids, "id", "left_semi")

    author = graph.edges.filter("type = 'CREATED_BY'").first()["dst"]
    plain = R.author_works(graph, author, 1)
    derived = R.author_works(Graph(graph.nodes, graph.edges, few=few), author, 1)
    assert sorted(map(str, derived.nodes.collect())) == sorted(map(str, plain.nodes.collect())) != []
    assert asked == [1]


def test_titles_are_dealt_out_before_they_are_analysed(graph):
    assert "RepartitionByExpression" in S.TokenIndex.of(graph.of_type("work")).postings._jdf.queryExecution().optimizedPlan().toString()
