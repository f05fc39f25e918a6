"""Every query of the subpackage against its SQL, and the pipeline as a whole."""

import pytest

import corpus_pipeline
from shelfgraph.llm.queries import ORACLES, QUERIES, table
from tests.compare import duck, run_duck, run_spark
from tests.conftest import SF
from tests.llm.common import lowered, nothing, odd


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark):
    got = run_spark(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert got == run_duck(duck(SF), ORACLES[name])
    assert got[1] or name == "op5_license_scan"


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns
        if k < 3:
            assert counts[-1] <= counts[-2]
        if k == 1:
            texts = [lowered(r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert docs.filter("not restored").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert run_spark(whole.drop("ids")) == run_spark(docs.drop("ids"))


@pytest.mark.parametrize("make", [odd, nothing])
def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path, make):
    """Each stage works on what the one before it kept, whatever the rows are."""
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns
    assert docs.filter("not restored").count() == 0 and (make is odd or docs.count() == 0)
