"""Resumable ingest: each run takes only what earlier runs have not seen."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfgraph.operators.limits import first_per_key
from shelfgraph.operators.upsert import publish, upsert_merge, version_path


BUCKETS = 64             # of each batch of append_new
BUCKET_ROWS = 1_000_000  # of upsert_stream


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a folder, new ones included."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    """The buckets that rows fall in: at most BUCKETS numbers."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


def append_new(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key is not in the target yet, the first row per key within a batch.

    The batch number is a folder of the target, and a repeated batch leaves its own folder out of
    the comparison and overwrites it. So a lost driver or executor changes nothing in the result, and
    the stream itself keeps no growing state. Below it, rows lie by a hash of their key: a batch reads earlier keys of its own buckets only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = first_per_key(batch, [key], [F.col(c) for c in order]).withColumn("bucket", _bucket(key))
        if batch_id > 0:
            kind = batch.schema[key].dataType.simpleString()
            stored = spark.read.schema(f"`{key}` {kind}, batch int, bucket int").parquet(target)
            seen = stored.filter((F.col("batch") < batch_id) & F.col("bucket").isin(_touched(first)))
            first = first.join(seen.select(key), key, "left_anti")
        first.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# A table that grows: extendible hashing. A bucket is all keys whose hash ends in some bits; the manifest has a row for each bucket with
# the version that holds its rows. A bucket that outgrows its size is written as two, four, ... buckets of more bits.
_MANIFEST = "bits int, value long, bucket string, held int, rows long"


def _placed(rows: DataFrame, key: str, buckets: DataFrame, levels: list[int]) -> DataFrame:
    """Rows with the ``bucket`` their key lies in; ``levels`` are the numbers of bits that occur."""
    asked = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_bits", F.explode(F.array(*[F.lit(b) for b in levels])))
    asked = asked.withColumn("_value", F.col("_hash").bitwiseAND(F.expr("shiftleft(1L, _bits) - 1L")))
    known = buckets.select(F.col("bits").alias("_b"), F.col("value").alias("_v"), "bucket")
    return asked.join(known, (F.col("_bits") == F.col("_b")) & (F.col("_value") == F.col("_v"))).drop("_hash", "_bits", "_value", "_b", "_v")


def _split(bits: int, value: int, rows: int, most: int) -> list[tuple[int, int]]:
    """The buckets that one with so many rows becomes."""
    more = max(0, math.ceil(math.log2(rows / most))) if rows > most else 0
    return [(bits + more, value | (i << bits)) for i in range(1 << more)]


def upsert_stream(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str,
                  start: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Keyed upsert of every batch: version N is version N-1 merged with batch N.

    Rows lie in buckets by a hash of their key (extendible hashing, about ``bucket_rows`` rows at most). A batch reads and writes the buckets its
    keys fall in; the manifest of a version names the version that holds each bucket, so the others stay where they are. A repeated batch reads
    the same old manifest and overwrites its own folders, so the result is the same. ``start`` is the table before the first batch.
    ``read_table`` reads a version, ``vacuum`` removes what only older ones hold.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        rank = F.struct(*order)
        source = batch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]).persist()
        first = batch_id == 0
        held = spark.createDataFrame([(0, 0, "0-0", -1, 0)], _MANIFEST) if first else manifest(spark, target, batch_id - 1)
        levels = [r.bits for r in held.select("bits").distinct().collect()]  # at most 64
        new = _placed(source.select(key), key, held, levels).groupBy("bucket").agg(F.count("*").alias("more"))
        touched = held.join(new.select(F.col("bucket").alias("b"), "more"), F.col("bucket") == F.col("b")).collect()  # the batch's buckets
        old = start if first else _read(spark, target, [(r.bucket, r.held) for r in touched if r.held >= 0])
        if first and start is not None:
            extra, touched = start.count(), touched or held.withColumn("more", F.lit(0)).collect()
        else:
            extra = 0
        parts = [(b, v, f"{b}-{v}") for r in touched for b, v in _split(r.bits, r.value, r.rows + r.more + extra, bucket_rows)]
        entries = held.join(spark.createDataFrame([(r.bucket,) for r in touched], "bucket string"), "bucket", "left_anti").select("bits", "value", "bucket", "held", "rows")
        if parts:
            merged = source if old is None else upsert_merge(old, source, key)
            into = spark.createDataFrame(parts, "bits int, value long, bucket string")
            placed = _placed(merged, key, into, sorted({b for b, _, _ in parts}))
            path = version_path(f"{target}/data", batch_id)
            placed.repartition(len(parts), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = spark.read.schema(placed.schema).parquet(path).groupBy("bucket").agg(F.count("*").alias("rows"))
            entries = entries.unionByName(into.join(written, "bucket", "left").select(
                "bits", "value", "bucket", F.when(F.col("rows").isNull(), -1).otherwise(batch_id).alias("held"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows")))
        publish(entries, f"{target}/manifest", batch_id)
        source.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def manifest(spark: SparkSession, target: str, version: int) -> DataFrame:
    """(bits, value, bucket, held, rows): which version holds each bucket of a version; -1 is none, for a bucket without rows."""
    return spark.read.schema(_MANIFEST).parquet(version_path(f"{target}/manifest", version))


def _folder(target: str, bucket: str, held: int) -> str:
    return f"{version_path(f'{target}/data', held)}/bucket={bucket}"


def _read(spark: SparkSession, target: str, held: list[tuple[str, int]]) -> DataFrame | None:
    """The rows of a batch's buckets."""
    return spark.read.parquet(*[_folder(target, b, v) for b, v in sorted(held)]) if held else None


def read_table(spark: SparkSession, target: str, version: int) -> DataFrame | None:
    """One version of a table kept by ``upsert_stream``; None while it has no rows."""
    held = manifest(spark, target, version).filter("held >= 0").select(F.col("held").alias("_held"), F.col("bucket").alias("_bucket"))
    if held.isEmpty():
        return None
    rows = spark.read.parquet(f"{target}/data")
    return rows.join(held, (F.col("version") == F.col("_held")) & (F.col("bucket") == F.col("_bucket")), "left_semi").drop("version", "bucket")


def vacuum(spark: SparkSession, target: str, version: int) -> int:
    """Remove the folders of buckets that no version from ``version`` on reads, and older manifests. Run it when no reader is at an older version."""
    whole = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{target}/manifest")
    needed = whole.filter(F.col("version") >= version).select("bucket", "held").distinct()
    stale = whole.filter((F.col("version") < version) & (F.col("held") >= 0)).select("bucket", "held").distinct().join(needed, ["bucket", "held"], "left_anti")
    old = [r.version for r in whole.filter(F.col("version") < version).select("version").distinct().collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [_folder(target, r.bucket, r.held) for r in stale.collect()] + [version_path(f"{target}/manifest", v) for v in old]
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def last_version(query: StreamingQuery) -> int | None:
    """Number of the last batch a finished query wrote."""
    progress = query.lastProgress
    return None if progress is None else int(progress["batchId"])


def new_rows(rows: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch form of the resume step: the first row per key in ``order``, keys already seen left out."""
    return first_per_key(rows.join(seen.select(key).distinct(), key, "left_anti"), [key], [F.col(c) for c in order])
