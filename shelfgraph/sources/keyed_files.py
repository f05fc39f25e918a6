"""Tables in files by ranges of a key, with a directory of the files: rows of few keys are read from the files that hold them.

Rows are range-partitioned by the key and further columns, so that a key with very many rows is spread over several files and no writer holds
more than its share. The directory has each file's first and last key and a Bloom filter of its keys in pieces; both are tables, and a
lookup reads the rows for the keys asked for. Opening a table lists no files.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_ROWS = 1_000_000
MOST_KEYS = 2_000           # more keys than this are joined with the whole table
SPANS = 64                  # ranges of keys that the directory is asked for at a time
PIECE_BITS = 32_768         # of bitmap_construct_agg
BLOOM_BITS = 32 * PIECE_BITS
BLOOM_TURNS = 2


def _places(key: Column) -> Column:
    """The bits of a key in its file's Bloom filter, as (piece, bit)."""
    places = [F.pmod(F.shiftright(F.xxhash64(key), 24 * turn), F.lit(BLOOM_BITS)) for turn in range(BLOOM_TURNS)]
    return F.array_distinct(F.array(*[F.struct(F.floor(p / PIECE_BITS).cast("int").alias("piece"), F.pmod(p, F.lit(PIECE_BITS)).alias("bit")) for p in places]))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(bit, F.lit(8)).cast("int") + 1)) != 0


@dataclass(frozen=True)
class KeyedFiles:
    """``path/rows`` by ranges of ``key``; ``path/files(file, lo, hi, rows)`` and ``path/blooms(file, piece, bits)``."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    shown: Callable[[DataFrame], DataFrame] = lambda rows: rows  # what readers get of the stored rows

    @staticmethod
    def write(df: DataFrame, path: str, key: str, *ties: str, partition_by: str | None = None, file_rows: int = FILE_ROWS) -> KeyedFiles:
        """Store a table. ``df`` is read several times, so an expensive one should be staged; ``ties`` order the rows of a key and part hot ones."""
        spark = df.sparkSession
        order = [*([partition_by] if partition_by else []), key, *ties]
        files = max(1, -(-df.count() // file_rows))
        writer = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", file_rows)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/rows")
        stored = KeyedFiles.open(spark, path, key, df.schema)
        rows = stored.all().select(F.substring_index("_metadata.file_path", "/rows/", -1).alias("file"), F.col(key).cast("string").alias("k"))
        if ties:  # a key's rows lie side by side: one row for each goes on
            rows = rows.groupBy("file", "k").agg(F.count("*").alias("n"))
        listed = rows.groupBy("file").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), (F.sum("n") if ties else F.count("*")).alias("rows"))
        listed.repartitionByRange(1 + files // 10_000, "lo").sortWithinPartitions("lo").write.mode("overwrite").parquet(f"{path}/files")
        bits = rows.select("file", F.explode(_places(F.col("k"))).alias("p")).groupBy("file", "p.piece").agg(F.bitmap_construct_agg("p.bit").alias("bits"))
        bits.repartitionByRange(1 + files // 100, "file").sortWithinPartitions("file", "piece").write.mode("overwrite").parquet(f"{path}/blooms")
        return stored

    @staticmethod
    def open(spark: SparkSession, path: str, key: str, schema: StructType | None = None, shown: Callable[[DataFrame], DataFrame] | None = None) -> KeyedFiles:
        return KeyedFiles(spark, path, key, schema or spark.read.parquet(f"{path}/rows").schema, *([shown] if shown else []))

    def all(self) -> DataFrame:
        return self.shown(self.spark.read.schema(self.schema).parquet(f"{self.path}/rows"))

    def files_of(self, keys: list[str]) -> list[str]:
        """Files that may hold some of the keys: those whose range and Bloom filter allow it."""
        if not keys:
            return []
        keys = sorted(set(keys))
        spans = [keys[i:i + -(-len(keys) // SPANS)] for i in range(0, len(keys), -(-len(keys) // SPANS))]
        inside = reduce(Column.__or__, [(F.col("lo") <= s[-1]) & (F.col("hi") >= s[0]) for s in spans])
        listed = self.spark.read.schema("file string, lo string, hi string, rows long").parquet(f"{self.path}/files").filter(inside).collect()
        asked = [(r.file, k) for r in listed for k in keys[bisect_left(keys, r.lo):bisect_right(keys, r.hi)]]
        if not asked:
            return []
        pairs = self.spark.createDataFrame(asked, "f string, k string").select("f", "k", F.explode(_places(F.col("k"))).alias("p")).select("f", "k", F.col("p.piece").alias("n"), "p.bit")
        blooms = self.spark.read.schema("file string, piece int, bits binary").parquet(f"{self.path}/blooms").filter(F.col("file").isin(sorted({f for f, _ in asked})))
        met = pairs.join(blooms, (F.col("f") == F.col("file")) & (F.col("n") == F.col("piece")), "left")
        clear = met.groupBy("f", "k").agg(F.min(F.coalesce(_is_set(F.col("bits"), F.col("bit")), F.lit(False))).alias("all")).filter("all")
        return sorted(r.f for r in clear.select("f").distinct().collect())

    def having(self, keys: list[str]) -> DataFrame:
        """The rows of these keys, read from the files that may hold them."""
        files = self.files_of(keys)
        if not files:
            return self.shown(self.spark.createDataFrame([], self.schema))
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{f}" for f in files])
        return self.shown(rows.filter(F.col(self.key).isin(keys)))

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in the one column of ``keys``. Few keys are looked up (a job collects them), many are joined with the table."""
        name = keys.columns[0]
        few = [r[0] for r in keys.filter(F.col(name).isNotNull()).limit(MOST_KEYS + 1).collect()]
        if len(few) <= MOST_KEYS:
            return self.having(sorted(set(few)))
        return self.all().join(keys.select(F.col(name).alias(self.key)), self.key, "left_semi")
