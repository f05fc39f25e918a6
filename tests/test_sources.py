"""File sources end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfgraph.operators import build as Bu
from shelfgraph.session import staged
from shelfgraph.sources import api_json, catalogue as C, cells, json_cut, jsonld, lookups


@pytest.fixture
def dump(tmp_path):
    books = [
        {"@id": "b1", "@type": "class:MangaBook", "schema:genre": "マンガ単行本", "schema:name": "ワンピース 1", "schema:volumeNumber": 1,
         "schema:creator": ["[著]尾田栄一郎", "編集部"], "dcterms:creator": {"@id": "C1"}, "schema:publisher": [{"@value": "集英社"}, "集英社 "],
         "schema:datePublished": "1997-12-24", "schema:description": "初出：「週刊少年ジャンプ」"},
        {"@id": "b2", "@type": "class:MangaBook", "schema:genre": "マンガ単行本", "schema:name": [{"@value": "ワンピース 2"}], "schema:volumeNumber": "2",
         "schema:creator": "尾田栄一郎", "dcterms:creator": {"@id": "C1"}, "schema:publisher": {"name": "集英社"}, "schema:datePublished": "1998-04-03"},
        {"@id": "b3", "@type": "class:MangaBook", "schema:genre": "その他", "schema:name": "skip"},
        "not an object",
    ]
    rest = [
        {"@id": "s1", "@type": "class:MangaBookSeries", "schema:genre": "マンガ単行本シリーズ", "schema:name": "ワンピース総集編",
         "schema:brand": ["ジャンプ・コミックス = JC"], "dcterms:creator": [{"@id": "C1"}, {"@id": "C2"}], "schema:creator": ["[原作]オダ"]},
        {"@id": "m1", "@type": "class:X", "schema:genre": "マンガ雑誌", "schema:name": "週刊少年ジャンプ", "schema:publisher": ["集英社", "講談社"]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"@graph": books}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"@graph": rest}, ensure_ascii=False, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    return str(tmp_path)


def test_jsonld_to_graph(spark, dump):
    items = jsonld.scan(spark, dump + "/*.json")
    assert items.count() == 6
    typed = staged(jsonld.typed_items(items), "items")
    assert {r.kind for r in typed.collect()} == {"book", "series", "magazine", None}
    brands = spark.createDataFrame([("ジャンプ・コミックス", "週刊少年ジャンプ")], "key string, value string")
    graph = Bu.build_graph(typed, brands)
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert set(nodes) == {"work:b1", "author:[著]尾田栄一郎", "author:C2", "publisher:集英社", "publisher:講談社", "magazine:週刊少年じゃんぷ"}
    work = nodes["work:b1"]
    assert (work.total_volumes, work.first_published, work.last_published, work.is_series) == (2, "1997-12-24", "1998-04-03", True)
    assert nodes["author:[著]尾田栄一郎"].label == "[著]尾田栄一郎"
    edges = {(r.src, r.type, r.dst) for r in graph.edges.collect()}
    assert edges == {("work:b1", "CREATED_BY", "author:[著]尾田栄一郎"), ("work:b1", "PUBLISHED_IN", "magazine:週刊少年じゃんぷ"),
                     ("magazine:週刊少年じゃんぷ", "PUBLISHED_BY", "publisher:集英社")}


def test_structure_profile(spark, dump):
    rows = {(r.key, r["shape"]): r.n for r in jsonld.structure_profile(jsonld.scan(spark, dump + "/*.json")).collect()}
    assert rows[("@id", "STRING")] == 5 and rows[("schema:volumeNumber", "BIGINT")] == 1


def test_name_probe(spark, dump):
    found = jsonld.name_probe(jsonld.scan(spark, dump + "/*.json"), "ワンピース")
    assert found.count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,title_name,english_name,authors,serialization,score\n'
                                    '1,"A ""quoted""\ntitle",,"[""X"", ""Y""]","[]",9.5\n2,,B,[],[],?\n ,x,,"[""Z""]",[],1\n3,C,,,"[\'M\']",Unknown\n')
    df = cells.read_text_csv(spark, str(tmp_path / "m.csv"))
    rows = {r.work_id: r for r in cells.relation_rows(df).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"].authors == ["X", "Y"] and rows["1"].title == 'A "quoted"\ntitle' and rows["3"].magazines == ["M"]
    typed = {r.id: r for r in cells.typed_rows(df, "id", {"score": "float", "authors": "list"}).collect()}
    assert set(typed) == {"1", "2", "3"}
    assert typed["1"].score == 9.5 and typed["2"].score is None and typed["2"].authors == [] and typed["2"].extra["english_name"] == "B"


def test_synopsis_rows(spark):
    df = spark.createDataFrame([("1", "A B！", " s "), ("2", "", "s"), ("3", "C", None)], "manga_id string, title_japanese string, synopsis string")
    assert [tuple(r) for r in cells.synopsis_rows(df).collect()] == [("1", "AB", "s")]


def test_api_dump(spark, tmp_path):
    record = {"id": 1, "title": "T", "alternative_titles": {"ja": "J", "en": "E", "synonyms": ["S"]}, "mean": 8.5, "rank": 3,
              "genres": [{"id": 1, "name": "Action"}, {"name": ""}], "authors": [{"node": {"first_name": "Test", "last_name": "Author"}, "role": "Art"}, {"node": {}}],
              "serialization": [{"node": {"name": "Test Magazine"}}], "related_anime": [{"node": {"id": 9, "title": "x"}, "relation_type": "adaptation"}],
              "main_picture": {"medium": "m"}, "recommendations": [{"node": {}}, {"node": {"id": 5, "title": "r"}}]}
    (tmp_path / "manga_1.json").write_text(json.dumps({"metadata": {}, "manga": [record, {"id": 2, "title": "U"}]}))
    (tmp_path / "manga_2.json").write_text(json.dumps([{"id": 1, "title": "later"}, {"title": "no id"}]))
    works = {r.id: r for r in api_json.manga_works(api_json.parse_records(api_json.scan(spark, str(tmp_path)))).collect()}
    assert set(works) == {"1", "2"}
    w = works["1"]
    assert (w.mal_id, w.title_name, w.genres, w.authors, w.serialization, w.main_picture) == (1, "T", ["Action"], ["Test Author"], ["Test Magazine"], "m")
    assert w.related_anime[0].relation_type == "adaptation" and [r.id for r in w.recommendations] == [5]
    assert works["2"].score is None and works["2"].genres == []


def test_wrapped_and_anime_records(spark):
    rows = spark.createDataFrame([('{"node":{"id":100,"title":"A","start_season":{"year":2024,"season":"spring"},"studios":[{"name":"S"}]},"ranking":{"rank":4}}',)], "record string")
    w = api_json.anime_works(api_json.parse_records(rows)).first()
    assert (w.id, w.start_season, w.studios, w.ranking_position) == ("anime_100", "spring 2024", ["S"], 4)


def test_entry_shapes(spark):
    text = '{"serialization":["A ",{"node":{"id":1,"name":"B"}},{"id":2,"name":"C"},{"node":"D"},""],' \
           '"authors":["X",{"node":{"id":1,"first_name":"F","last_name":"L"},"role":"Art"},{"last_name":"M"},{"node":"N","role":"r"},{"role":"none"}]}'
    item = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("item"))
    r = item.select(api_json.serialization_entries("item").alias("s"), api_json.author_entries("item").alias("a")).first()
    assert [(x.id, x.name) for x in r.s] == [(None, "A"), (1, "B"), (2, "C"), (None, "D")]
    assert [(x.name, x.role) for x in r.a] == [("X", ""), ("F L", "Art"), ("M", ""), ("N", "r")]


def test_lookups(spark, tmp_path):
    (tmp_path / "p.json").write_text('{" 集英社 ": ["A", " A", "B  C", "none"], "": ["x"], "P": []}')
    rows = lookups.publisher_magazines(lookups.read_map_text(spark, str(tmp_path / "p.json")))
    assert [(r.publisher, r.rank, r.magazine) for r in rows.orderBy("rank").collect()] == [("集英社", 0, "A"), ("集英社", 1, "B C"), ("集英社", 2, "none")]
    (tmp_path / "b.json").write_text('{"c1": {"J": "one", "K": "k"}, "c2": {"J": "two"}}')
    rows = lookups.brand_magazines(lookups.read_map_text(spark, str(tmp_path / "b.json")))
    assert {(r.key, r.value) for r in rows.collect()} == {("J", "two"), ("K", "k")}


def test_payloads(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x00\x01" * 100)
    r = C.read_payloads(spark, str(tmp_path)).first()
    assert r["size"] == 200 and r.success and len(r.data) == 268


def test_mapping_inside_one_file(spark):
    texts = spark.createDataFrame([(1, '{"A ": ["x"], "A": ["y", 5, null, " y "], "B": "no list", "C": ["Unknown"]}'), (2, '{"C": []}')], "pos int, text string")
    assert {tuple(r) for r in lookups.publisher_magazines(texts).collect()} == {("A", 0, "y"), ("C", 0, "Unknown")}


def test_cells_written_as_literals(spark):
    cells_ = ["3D", "5f", "1e3", ".5", "{'a': 1, 'b': None}", "['a', None]", "[1, 'it\\'s', \"None\"]", "{'q': 'say \"x\"'}", "[broken", "NaN"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells_)], "i int, c string")
    got = {r.i: r.v for r in df.select("i", cells.typed_cell("c").alias("v")).collect()}
    assert [got[i].kind for i in range(10)] == ["text", "text", "float", "float", "object", "list", "list", "object", "text", "float"]
    assert got[4].text == '{"a": 1, "b": null}' and got[5]["items"] == ["a", None] and got[6]["items"] == ["1", "it's", "None"]
    assert got[7].text == '{"q": "say \\"x\\""}'


@pytest.fixture
def small_blocks(spark):
    """Files read in blocks of some hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "150b", "spark.sql.files.openCostInBytes": "0b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _nasty(rng, depth=0):
    if depth == 3 or rng.random() < 0.4:
        words = ['}', '{', '[', ']', ',', '"', '\\', '\\"', '":[', 'a', 'é', '鋼', ' ', '}}', '\n', '"@graph":[', '\\\\']
        return rng.choice([rng.randint(-9, 9), None, True, 1.5, "".join(rng.choice(words) for _ in range(rng.randint(0, 30)))])
    if rng.random() < 0.5:
        return [_nasty(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(['a', '}', '"', '@graph', '[']) + str(i): _nasty(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_documents_cut_by_many_tasks(spark, tmp_path, small_blocks):
    """Documents with brackets, quotes and backslashes in strings, in blocks that begin anywhere: the same items as a parser finds."""
    rng = random.Random(11)
    want = {}
    for i in range(14):
        items = [_nasty(rng) for _ in range(rng.randint(0, 25))]
        doc = [{"@graph": items}, {"x": _nasty(rng), "@graph": items, "y}": [1, {"@graph": [2]}]}, {"@context": {"@graph": [1]}, "z": "}", "@graph": items}, {"manga": items}][i % 4]
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, ensure_ascii=i % 3 == 0, indent=rng.choice([None, 1])) + rng.choice(["", "\n"]), encoding="utf-8")
        want[f"{i}.json"] = items if i % 4 < 3 else []
    (tmp_path / "list.json").write_text(json.dumps([{"@graph": [1]}, []]))
    (tmp_path / "empty.json").write_text("")
    parts = json_cut.cut(spark, f"{tmp_path}/*.json", ["@graph"])
    got = {}
    for r in parts.orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, json.loads(r.text)))
    assert got == {k: list(enumerate(v)) for k, v in want.items() if v}
    assert [(r.pos, json.loads(r.text)) for r in json_cut.cut(spark, f"{tmp_path}/list.json", [""]).orderBy("pos").collect()] == [(0, {"@graph": [1]}), (1, [])]


def test_split_scan_equals_the_scan(spark, dump, tmp_path_factory, small_blocks):
    rows = lambda df: sorted((r.file, r.pos, r.item.toPython() if r.item is not None else None) for r in df.collect())
    key = lambda rs: [(f, p, json.dumps(i, sort_keys=True, ensure_ascii=False)) for f, p, i in rs]
    assert key(rows(jsonld.scan_split(spark, dump + "/*.json"))) == key(rows(jsonld.scan(spark, dump + "/*.json")))
    folder = tmp_path_factory.mktemp("big")
    (folder / "big.json").write_text(json.dumps({"@context": {}, "@graph": [{"@id": f"b{i}", "schema:name": "}" * (i % 7)} for i in range(3000)]}))
    pieces = spark.read.option("lineSep", "}").text(str(folder))
    assert pieces.rdd.getNumPartitions() > 200  # many tasks read the one document
    split, plain = jsonld.scan_split(spark, str(folder)), jsonld.scan(spark, str(folder))
    ids = lambda df: sorted((r.pos, r.id) for r in df.select("pos", jsonld.field("item", "@id", "string").alias("id")).collect())
    assert ids(split) == ids(plain) and len(ids(split)) == 3000


def test_split_api_dump(spark, tmp_path, small_blocks):
    (tmp_path / "manga_1.json").write_text(json.dumps({"metadata": {"manga": [1]}, "anime": [{"id": 77}], "manga": [{"id": i, "t": "]}"} for i in range(40)]}))
    (tmp_path / "manga_2.json").write_text(json.dumps([{"id": 1, "title": "later"}, {"title": "no id"}, {"id": 99}]))
    (tmp_path / "anime_1.json").write_text(json.dumps({"anime": [{"id": 7, "x": "y"}, {"id": 100}]}))
    rows = lambda df: sorted((r.file, r.pos, r.id, json.dumps(json.loads(r.record))) for r in df.collect())
    assert rows(api_json.scan_split(spark, str(tmp_path))) == rows(api_json.scan(spark, str(tmp_path)))


def test_numbers_as_the_importer_reads_them(spark):
    cells_ = ["１２", "-３", "1_000", "1_000.5e1_0", "1__0", "_1", "１.５", "+5", "1e", "12 "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells_)], "i int, c string")
    got = [(r.v.kind, r.v.number) for r in df.orderBy("i").select(cells.typed_cell("c").alias("v")).collect()]
    assert got == [("int", 12.0), ("int", -3.0), ("float", 1000.0), ("float", 1000.5e10), ("text", None), ("text", None), ("float", 1.5), ("float", 5.0), ("text", None),
                   ("int", 12.0)]


def test_csv_cut_by_many_tasks(spark, tmp_path, small_blocks):
    """Cells with commas, doubled quotes, stray quotes and line breaks, in blocks that begin anywhere: the rows of the one-task reader."""
    import csv

    from shelfgraph.sources import csv_cut
    rng = random.Random(3)
    words = ["a", 'q"', '"', "\n", ",", "\n\n", "é", "鋼", " x", '""', "end"]
    for k in range(4):
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(["id", "title, full", "text"])
            for i in range(120):
                cells_ = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(2)]
                writer.writerow([f"{k}-{i}", *cells_])
                if i % 17 == 0:
                    file.write('\n' + f"{k}-stray{i}" + ',5" disk,x"y\n')
    rows = lambda df: sorted(tuple(r) for r in df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("<null>")) for c in df.columns]).collect())
    split, plain = csv_cut.read_csv(spark, str(tmp_path)), cells.read_text_csv(spark, str(tmp_path))
    assert split.columns == plain.columns == ["id", "title, full", "text"]
    got, want = rows(split), rows(plain)
    assert len(want) == 4 * 128 and got == want
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    assert csv_cut.read_csv(spark, str(empty)).count() == 0


def test_state_at_a_line_end():
    from shelfgraph.sources.csv_cut import ends_inside
    cases = {b'a,"b': (True, False), b'a,b"c': (False, False), b'"a""b",c': (False, True), b'x"': (False, False), b'x","y': (True, False), b'': (False, True),
             b'"': (True, False), b'""': (False, True), b'"a",b",c': (False, False)}
    for line, (outside, inside) in cases.items():
        assert ends_inside(line, False) == outside, line
    assert ends_inside(b'b",c', True) is False and ends_inside(b'b""c', True) is True and ends_inside(b'b","d', True) is True and ends_inside(b'b', True) is True


def test_usual_shapes_are_told_from_the_whole_value(spark):
    """Strings, objects and lists of either, next to shapes that are looked at element by element."""
    cases = [
        ('"a"', ["a"], []), ('""', [], []), ("null", [], []), ("1", [], []), ('{"@value":"v"}', ["v"], []), ('{"name":"n"}', ["n"], []),
        ('{"@value":"","name":"n"}', [], []), ('{"@value":1}', [], []), ('["a",null,"","b"]', ["a", "b"], []), ('["a",1,{"@value":"c"}]', ["a", "c"], []),
        ('{"@id":"i"}', [], ["i"]), ('[{"@id":"i"},null,{"@id":3},{"x":1}]', [], ["i", "3"]), ('[{"@id":"i"},"a"]', ["a"], ["i"]), ("[]", [], []), ("no json", [], []),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    made = rows.select("i", jsonld.as_strings("v").alias("s"), jsonld.as_ids("v").alias("ids"), jsonld.as_strings("v", single_object=False).alias("m"))
    found = {r.i: r for r in made.collect()}
    for i, (text, strings, ids) in enumerate(cases):
        assert (found[i].s, found[i].ids) == (strings, ids), text
        assert found[i].m == ([] if text.startswith("{") else strings), text
    plan = rows.select(jsonld.as_strings("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "= STRING" in plan.split("lambda")[0]  # told before any function over elements


def test_lines_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    """The number of tasks that parse books is that of a shuffle, whatever the bytes of the lines."""
    from shelfgraph.plans import source_binding as B

    rows = spark.range(40).selectExpr("id l_orderkey", "id l_partkey", "1L l_suppkey", "1 l_linenumber", "'R' l_returnflag", "'O' l_linestatus",
                                      "timestamp_ntz'1995-01-01' l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).selectExpr("id p_partkey", "'a b' p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 1L s_suppkey, 'S' s_name, 0 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select 0 n_nationkey, 'N' n_name, 0 n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    books = B.typed_books(spark, str(tmp_path))
    assert books.count() == 40
    assert "REPARTITION_BY_NUM" in books._jdf.queryExecution().executedPlan().toString()


def test_author_names_read_the_items_once(spark):
    rows = [("book", True, ["a"], ["x", "編集部"]), ("book", True, ["b"], ["編集部"]), ("book", False, ["c"], ["y"]), ("series", False, ["d", "e"], ["z", None]),
            ("series", False, [], ["q"]), ("series", True, None, ["q"]), ("series", True, [None, "g"], ["q"]), ("magazine", True, ["h"], ["i"]),
            ("book", True, ["a"], ["w"]), ("book", None, ["k"], ["w"]), ("series", True, ["m"], None), ("series", True, ["d"], ["z"])]
    items = spark.createDataFrame(rows, "kind string, one_creator boolean, creator_ids array<string>, creator_names array<string>")
    names = Bu.author_names(items.repartition(3))
    assert sorted(map(str, map(tuple, names.collect()))) == sorted(map(str, [
        ("a", "w"), ("a", "x"), ("b", None), ("d", "z"), ("d", None), ("e", None), ("g", None), ("m", None), (None, None)]))
    assert names._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
