"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "shelfgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew-join handling.

    Cluster sizes (executors, memory, shuffle partitions) are left to spark-submit; AQE coalesces
    the shuffle partitions from there.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for files a job must write, under the shared ``spark.checkpoint.dir``.

    A session that names no such folder uses its warehouse, which a cluster points at shared storage too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to a table and read back: for an expensive input that several steps read."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over as many tasks as a shuffle has: for much work on each row of a table that lies in few files. A given number is not coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
