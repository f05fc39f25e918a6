import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfgraph import get_spark  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def free_cache(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture
def value(spark):
    """Evaluate a column expression over one row of named values."""
    def run(expr, schema="x string", *row):
        df = spark.createDataFrame([row or (None,)], schema)
        return df.select(expr.alias("v")).first()[0]
    return run
