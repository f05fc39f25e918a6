"""Upserts, duplicates, expiry, embeddings and incremental ingest."""

import pytest
from pyspark.sql import functions as F

from shelfgraph.functions.vectors import vector_literal
from shelfgraph.graph import Graph, edge_id
from shelfgraph.operators import quality as Q, ttl, upsert as U, vector as Ve
from shelfgraph.plans import all_queries
from shelfgraph.plans.vector_queries import length_model
from shelfgraph.streaming import incremental as I
from tests.conftest import SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sides(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", None, "z")], "id string, n int, t string")
    new = spark.createDataFrame([("b", None, "new"), ("c", 9, None), ("d", 4, "w")], "id string, n int, t string")
    return old, new


def test_merge(sides):
    merged = U.upsert_merge(*sides, "id")
    assert rows(merged) == [("a", 1, "x"), ("b", 2, "new"), ("c", 9, "z"), ("d", 4, "w")]
    assert rows(U.upsert_merge(merged, sides[1], "id")) == rows(merged)


def test_insert_only(sides):
    assert rows(U.insert_missing(*sides, "id")) == [("a", 1, "x"), ("b", 2, None), ("c", None, "z"), ("d", 4, "w")]


def test_update_only(sides):
    assert rows(U.update_existing(*sides, "id")) == [("a", 1, "x"), ("b", 2, "new"), ("c", 9, "z")]
    assert rows(U.update_existing(*sides, "id", nulls_overwrite=True)) == [("a", 1, "x"), ("b", None, "new"), ("c", 9, None)]
    assert U.matched_count(*sides, "id").first()[0] == 2


def test_last_filled(spark):
    df = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, None, 6), ("a", 3, "y", None), ("b", 1, None, None)], "id string, ord int, t string, n int")
    assert rows(U.last_filled_per_key(df, "id", "ord")) == [("a", "y", 6), ("b", None, None)]


def test_hot_key(spark):
    """A third of all rows under one key are reduced to one row, with every key kept."""
    df = spark.range(9000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("ord"), F.col("id").alias("v"))
    out = U.last_filled_per_key(df, "k", "ord")
    assert out.count() == 6001 and out.filter("k = 'hot'").first().v == 2999
    plan = Q.drop_duplicates(df, ["k"], [F.col("ord")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before the shuffle, once after


def test_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    new = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("a", "z", "T"), ("b", "a", "T")], "src string, dst string, type string")
    none = new.filter(F.lit(False)).withColumn("id", F.lit(""))
    merged = U.merge_edges(none, new, nodes)
    assert rows(merged.select("src", "dst")) == [("a", "b"), ("b", "a")]
    assert U.merge_edges(merged, new, nodes).count() == 2
    assert rows(U.dangling_edges(new, nodes)) == [("a", "z", "T")]


def test_unique(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "id string")
    with pytest.raises(ValueError, match="duplicate key"):
        U.assert_unique(df, ["id"])
    U.assert_unique(df.filter("id IS NULL"), ["id"])


def test_dedupe_graph(spark):
    nodes = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", None), ("5", None)], "id string, name string")
    edges = spark.createDataFrame([("e1", "1", "3", "T"), ("e2", "2", "3", "T"), ("e3", "2", "4", "T")], "id string, src string, dst string, type string")
    g = Q.dedupe_graph(Graph(nodes, edges), ["name"])
    assert [r.id for r in g.nodes.orderBy("id").collect()] == ["1", "3", "4", "5"] and rows(g.edges.select("src", "dst")) == [("1", "3")]
    g = Q.dedupe_graph(Graph(nodes, edges), ["name"], rewire=True)
    assert rows(g.edges.select("src", "dst")) == [("1", "3"), ("1", "4")]


def test_coverage_of_nothing(spark):
    df = spark.createDataFrame([], "id string, e int")
    assert rows(Q.coverage(df, "e")) == [(0, 0, 0.0)]


def test_export(spark, tmp_path):
    U.export_with_metadata(spark.range(7), str(tmp_path / "x"), source="s")
    meta = spark.read.json(str(tmp_path / "x/metadata")).first()
    assert (meta.total, meta.source) == (7, "s")


CACHE = "key string, isbn string, title string, cover_url string, ts double"


def test_cache(spark):
    cache = spark.createDataFrame([("i1", "i1", None, "u", 100.0), ("i2", "i2", None, None, 100.0), ("i3", "i3", None, "u", 10.0)], CACHE)
    asked = spark.createDataFrame([("i1",), ("i2",), ("i3",), ("i4",)], "key string")
    assert rows(ttl.lookup(asked, cache, 120.0, 50.0)) == [("i1", "u", "hit"), ("i2", None, "negative"), ("i3", None, "expired"), ("i4", None, "miss")]
    entry = spark.createDataFrame([("i1", "i1", None, None, 130.0), ("", "", None, "x", 130.0)], CACHE)
    after = ttl.put(cache, entry)
    assert [tuple(r) for r in after.filter("key = 'i1'").select("cover_url", "ts").collect()] == [(None, 130.0)] and after.count() == 3
    assert ttl.drop_expired(cache, 120.0, 50.0).count() == 2
    assert ttl.invalidate(cache).count() == 0 and ttl.invalidate(cache, asked.limit(1)).count() == 2
    assert rows(ttl.stats(cache, 120.0, 50.0)) == [(3, 2, 1, 2, 1)]


@pytest.fixture
def vectors(spark):
    data = [("w1", [1.0, 0.0], ["Action"]), ("w2", [0.9, 0.1], ["Hentai"]), ("w3", [0.0, 1.0], None), ("w4", None, None), ("w5", [0.0, 0.0], None)]
    return spark.createDataFrame(data, "id string, embedding_title_en array<float>, genres array<string>").selectExpr(
        "*", "id as work_id", "id as title_name", "cast(null as string) as title", "cast(null as string) as english_name",
        "cast(null as string) as japanese_name", "cast(null as string) as media_type")


def test_nearest(vectors):
    col = "embedding_title_en"
    works = vectors.drop(col)
    assert [r.id for r in Ve.similar_works(vectors, works, [1.0, 0.0], col, 5, 0.5).collect()] == ["w1"]
    assert [r.id for r in Ve.similar_works(vectors, works, [1.0, 0.0], col, 5, 0.5, None).collect()] == ["w1", "w2"]
    assert [r.id for r in Ve.nearest(vectors, works, [0.9, 0.1], col, 1).collect()] == ["w1"]  # the nearest has the excluded genre
    assert [r.id for r in Ve.nearest(vectors, works.filter("id <> 'w3'"), [0.0, 1.0], col, 1, None, None).collect()] == ["w2"]  # no work, no hit
    assert [r.id for r in Ve.nearest_to_work(vectors, "w3", col, 2).collect()] == ["w3", "w2"]
    with pytest.raises(ValueError):
        Ve.similar_works(vectors, works, [1.0], "title")
    with pytest.raises(ValueError):
        Ve.similar_works_multi(vectors, works, [1.0, 0.0], ["x"])


def test_two_columns_with_their_own_vectors(vectors):
    both = vectors.withColumn("embedding_title_ja", F.reverse("embedding_title_en"))
    found = Ve.similar_works_multi(both, vectors.drop("embedding_title_en"), {"embedding_title_en": [1.0, 0.0], "embedding_title_ja": [1.0, 0.0]},
                                   ["embedding_title_en", "embedding_title_ja"], 5, 0.95, None)
    assert {r.id: round(r.similarity_score, 6) for r in found.collect()} == {"w1": 1.0, "w2": 0.993884, "w3": 1.0}


def test_vectors_are_not_shuffled(spark, vectors, tmp_path):
    col = "embedding_title_en"
    vectors.select("id", col).write.parquet(str(tmp_path / "v"))
    vectors.drop(col).write.parquet(str(tmp_path / "w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Ve.similar_works(spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "w")), [1.0, 0.0], col, 5, 0.5)
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = [part.split("\n")[1] for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert inputs and not any(col in line for line in inputs)


def test_hybrid(spark):
    text = spark.createDataFrame([("1",), ("2",)], "id string")
    near = spark.createDataFrame([("1", 0.9), ("3", 0.8)], "id string, similarity_score double")
    scores = {r.id: r.search_score for r in Ve.hybrid(text, near, 10).collect()}
    assert scores == {"1": pytest.approx(1.0), "2": 0.7, "3": 0.8}
    assert Ve.hybrid(text, None, 10).count() == 2 and Ve.hybrid(None, near, 1).first().id == "1"
    with pytest.raises(ValueError):
        Ve.hybrid(None, None, 10)


def test_embed(spark):
    df = spark.createDataFrame([("aei",), (None,), ("  ",)], "t string")
    assert [r.v for r in Ve.embed(df, "t", "v", 3, length_model).collect()] == [[3.0, 3.0, 0.0], None, None]

    def failing():
        def encode(texts):
            raise RuntimeError
        return encode

    native = Ve.embed(df, "t", "v", 3).collect()
    assert [r.v for r in Ve.embed(df, "t", "v", 3, failing).collect()] == [r.v for r in native]
    assert len(native[0].v) == 3 and native[1].v is None


def test_backfill(spark):
    df = spark.createDataFrame([("1", "A", "g", [1.0]), ("2", "B", "", None), ("3", None, "g", None)], "id string, title string, genre string, e array<double>")
    out = Ve.backfill_embeddings(df, "e", 4, "title", "genre")
    assert {r.id: r.status for r in out.collect()} == {"1": "kept", "2": "added", "3": "kept"}
    assert rows(Ve.backfill_counts(out)) == [(1, 1, 0, 0)]

    def broken():
        raise RuntimeError("no such model")

    out = Ve.backfill_embeddings(df, "e", 4, "title", "genre", broken)
    assert rows(Ve.backfill_counts(out)) == [(1, 0, 0, 1)] and {r.method for r in out.collect()} == {None, "hash"}


def test_resume(spark, tmp_path):
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "id bigint, v string"

    def land(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = I.append_new(I.read_files(spark, source, schema, files_per_batch=1), "id", ["v"], target, check)
        q.awaitTermination()
        return rows(spark.read.parquet(target).select("id", "v"))

    land("a", [(1, "a"), (1, "b"), (2, "c")])
    assert run() == [(1, "a"), (2, "c")]
    assert run() == [(1, "a"), (2, "c")]
    land("b", [(2, "z"), (3, "d")])
    assert run() == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_stream(spark, tmp_path):
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "id bigint, ord bigint, v string"
    start = spark.createDataFrame([(1, 0, "old"), (9, 0, "keep")], schema)

    def run(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        q = I.upsert_stream(I.read_files(spark, source, schema), "id", ["ord"], target, check, start)
        q.awaitTermination()
        return rows(I.read_table(spark, target, I.last_version(q)).select("id", "v"))

    assert run([(1, 1, "a"), (1, 2, None)]) == [(1, "a"), (9, "keep")]
    assert run([(2, 3, "b"), (1, 4, "c")]) == [(1, "c"), (2, "b"), (9, "keep")]


def test_buckets_split_and_few_are_rewritten(spark, tmp_path):
    """Ten keys of a table of a thousand buckets rewrite the buckets they lie in; versions stay readable until they are vacuumed."""
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "id bigint, ord bigint, v string"

    def run(df, files=1):
        df.coalesce(files).write.mode("append").parquet(source)
        q = I.upsert_stream(I.read_files(spark, source, schema), "id", ["ord"], target, check, bucket_rows=40)
        q.awaitTermination()
        return I.last_version(q)

    held = lambda v: {r.bucket: (r.held, r.rows) for r in I.manifest(spark, target, v).collect()}
    assert run(spark.range(500).selectExpr("id", "0L AS ord", "'a' AS v")) == 0
    assert run(spark.range(300, 2000).selectExpr("id", "1L AS ord", "'b' AS v")) == 1
    first, second = held(0), held(1)
    assert len(first) == 16 and len(second) > len(first) and max(n for _, n in second.values()) < 90 and sum(n for _, n in second.values()) == 2000
    few = spark.createDataFrame([(i, 2, "c") for i in range(1990, 2010)], schema)
    assert run(few) == 2
    third = held(2)
    same = [b for b in second if third.get(b) == second[b]]
    assert len(same) >= len(second) - 20 and sum(n for _, n in third.values()) == 2010
    want = {i: "a" for i in range(300)} | {i: "b" for i in range(300, 1990)} | {i: "c" for i in range(1990, 2010)}
    read = lambda v: {r.id: r.v for r in I.read_table(spark, target, v).collect()}
    assert read(2) == want and len(read(1)) == 2000 and len(read(0)) == 500
    assert run(few) == 3 and read(3) == want  # the same rows again change nothing
    assert I.vacuum(spark, target, 3) > 10 and read(3) == want
    assert I.vacuum(spark, target, 3) == 0
    files = {p.parent.name for p in (tmp_path / "out" / "data").rglob("*.parquet")}
    assert len(list((tmp_path / "out" / "data").rglob("bucket=*"))) == len([1 for v, n in held(3).values() if n]) and files


def test_vector_literal(spark):
    assert spark.range(1).select(vector_literal([1, 2.5]).alias("v")).first().v == [1.0, 2.5]


def test_copies_of_different_types_stay_apart(spark):
    nodes = spark.createDataFrame([("1", "work", "Jump", None), ("2", "magazine", "Jump", None), ("3", "work", "Jump", "k"), ("4", "work", "Jump", None)],
                                  "id string, type string, name string, k string")
    edges = spark.createDataFrame([("old", "4", "2", "T"), ("kept", "1", "2", "U")], "id string, src string, dst string, type string")
    g = Q.dedupe_graph(Graph(nodes, edges), ["name"], rewire=True, only_without="k")
    assert [r.id for r in g.nodes.orderBy("id").collect()] == ["1", "2", "3"]
    ids = {r.type: r.id for r in g.edges.collect()}
    assert ids["U"] == "kept" and ids["T"] == spark.range(1).select(edge_id(F.lit("1"), F.lit("T"), F.lit("2"))).first()[0]
    assert [tuple(r) for r in Q.duplicate_report(nodes, ["name"]).collect()] == [("work", "Jump", 3)]


def test_vector_cells_equal_the_scan(spark, tmp_path, monkeypatch):
    """Every tenth vector as a query, plus odd ones; far less than all cells are read, and no exchange carries a vector."""
    import numpy as np

    from shelfgraph.operators import vector_cells as C
    monkeypatch.setattr(C, "FIRST_ROWS", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(f"w{i:04d}", (centres[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1]), ("zero", [0.0] * 16), ("none", None), ("short", [1.0])]
    col = "embedding_title_en"
    vectors = spark.createDataFrame(rows, f"id string, {col} array<float>")
    works = vectors.select("id", F.when(F.col("id") < "w0003", "Hentai").alias("genre"), F.array().cast("array<string>").alias("genres")).filter("id <> 'w0050'").persist()
    cells = C.VectorCells.write(vectors, str(tmp_path), col)
    assert cells.all().count() == 602 and cells.cells[3].sum() == 602
    share = []
    cells = C.VectorCells.open(spark, str(tmp_path), col)
    for i in range(0, 600, 10):
        query = [float(x) for x in rows[i][1]]
        read = cells.cells_to_read(query, 5)
        share.append(len(read) / len(cells.cells[0]))
        if i % 150 == 0:
            for genre in (None, "Hentai"):
                a, b = ([(r.id, r.similarity_score) for r in Ve.nearest(v, works, query, col, 5, None, genre).collect()] for v in (vectors, cells))
                assert a == b
        plain = np.array([r[1] for r in rows[:600]]) @ np.array(query)
        best = np.argsort(-plain / np.linalg.norm([r[1] for r in rows[:600]], axis=1))[:5]
        held = {r.id for r in cells.all().filter(F.col("cell").isin(read)).select("id").collect()} if i % 100 == 0 else None
        assert held is None or {rows[k][0] for k in best} <= held
    assert np.mean(share) < 0.35, np.mean(share)
    far = [float(x) for x in rng.normal(size=16)]
    a, b = ([(r.id, r.similarity_score) for r in Ve.nearest(v, works, far, col, 700, None, None).collect()] for v in (vectors, cells))
    assert a == b and len(a) == 601
    plan = Ve.nearest(cells, works, far, col, 5)._jdf.queryExecution().executedPlan().toString()
    assert all("vector" not in line for line in plan.splitlines() if "Exchange" in line)
    with pytest.raises(ValueError):
        cells.near([1.0], 5)
    assert cells.near([0.0] * 16, 5).count() == 0
    nothing = C.VectorCells.write(vectors.limit(0), f"{tmp_path}/none", col)
    assert nothing.near(far, 5).count() == 0


def test_nearest_to_work_by_cells(spark, tmp_path):
    from shelfgraph.operators.vector_cells import VectorCells
    col = "embedding_title_en"
    works = spark.createDataFrame([(f"w{i}", [float(i % 7), 1.0, float(i % 5)]) for i in range(60)] + [("x", None)], f"id string, {col} array<float>")
    cells = VectorCells.write(works, str(tmp_path), col)
    for id_ in ("w3", "w41"):
        a, b = ([(r.id, round(r.similarity_score, 9)) for r in Ve.nearest_to_work(works, id_, col, 9, c).collect()] for c in (None, cells))
        assert a == b and len(a) == 9
    assert Ve.nearest_to_work(works, "x", col, 9, cells).count() == Ve.nearest_to_work(works, "nope", col, 9, cells).count() == 0


def test_rows_of_one_small_file_are_dealt_out(spark, tmp_path):
    """Records of a table in one file are parsed by as many tasks as a shuffle has, not by one."""
    from shelfgraph.plans import source_binding
    rows = spark.range(40).selectExpr("id AS p_partkey", "'red ring' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "int(id) AS p_size", "9.0D AS p_retailprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (source_binding.api_records(spark, str(tmp_path)), source_binding.series_texts(spark, str(tmp_path))):
        assert made.count() == 40 and made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_a_hub_are_looked_up_apart(spark):
    """The rows of one key meet their value in many tasks, and no side is broadcast; repeated, missing and null keys are those of a left join."""
    from shelfgraph.operators.limits import look_up

    rows = spark.range(400).selectExpr("if(id < 300, 'hub', if(id < 310, null, concat('k', id))) AS dst", "concat('w', id) AS src")
    values = spark.createDataFrame([("hub", 1), ("k311", 2), ("k311", 3), (None, 4), ("other", 5)], "dst string, v int")
    found = look_up(rows, "dst", "src", values)
    assert sorted(map(str, found.select("src", "dst", "v").collect())) == sorted(map(str, rows.join(values, "dst", "left").select("src", "dst", "v").collect()))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    at = found.filter("dst = 'hub'").groupBy(F.spark_partition_id()).count().count()
    assert at > 1


def test_rewired_edges_shuffle_no_digest(spark):
    nodes = spark.createDataFrame([("a", "work", "x"), ("b", "work", "x"), ("c", "work", "y"), ("m", "magazine", None)], "id string, type string, title string")
    edges = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m"), (None, "m")], "src string, dst string").withColumn("type", F.lit("IN")).withColumn("id", edge_id("src", "type", "dst"))
    edges = edges.unionByName(spark.createDataFrame([("own", "c", "c", "IN")], "id string, src string, dst string, type string"))
    found = Q.dedupe_graph(Graph(nodes, edges), ["title"], rewire=True).edges
    digest = lambda *ends: spark.range(1).select(edge_id(F.lit(ends[0]).cast("string"), F.lit("IN"), F.lit(ends[1]))).first()[0]
    want = [(digest("a", "m"), "a", "m"), (digest("c", "m"), "c", "m"), (digest(None, "m"), None, "m"), ("own", "c", "c")]
    assert sorted(map(str, [(r.id, r.src, r.dst) for r in found.collect()])) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_made" in plan and plan.index("sha2") < plan.rindex("RepartitionByExpression")


@pytest.mark.parametrize("name", ["r15_build_nodes", "r15_build_edges"])
def test_items_of_a_build_are_stored_and_not_cached(spark, tmp_path, name):
    """Cached items took the executors' memory; stored ones are read as Parquet by each branch of the plan."""
    tables = {
        "lineitem": ([(1, 1, 1, 1, "R", "O", "1996-01-02"), (1, 1, 1, 1, "R", "O", "1996-01-02"), (2, 2, 1, 1, "A", "F", "1997-03-04")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate string"),
        "part": ([(1, "RED ROSE", 30, "Brand#1"), (2, "BLUE SEA", 10, "Brand#9")], "p_partkey long, p_name string, p_size int, p_brand string"),
        "supplier": ([(1, "Ann", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "AMERICA")], "r_regionkey int, r_name string"),
    }
    for t, (rows, schema) in tables.items():
        own = spark.createDataFrame(rows, schema)
        types = spark.read.parquet(f"{SF}/{t}.parquet").schema
        own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in types]).write.parquet(f"{tmp_path}/{t}.parquet")
    found = all_queries().QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "parquet" in plan
    if name == "r15_build_nodes":
        want = {("work", "RED ROSE"), ("work", "BLUE SEA"), ("author", "[著]Ann"), ("publisher", "PERU"), ("publisher", "AMERICA"), ("magazine", "PERU")}
        assert {(r.type, r.label) for r in found.collect()} == want
    else:
        assert {(r.type, r.dst) for r in found.collect()} == {("CREATED_BY", "author:[著]ann"), ("PUBLISHED_IN", "magazine:peru"), ("PUBLISHED_BY", "publisher:america")}
