"""Vectors in inverted-file cells with exact pruning: a search reads the cells that can hold one of the best vectors.

Centroids come from k-means (cosine) on a bounded sample; every vector goes to its nearest centroid, and a cell keeps the largest angle of
a member to its centroid. A member's angle to a query is at least (angle of query and centroid) - (angle of the cell), so cells are read
while that bound allows a score as good as the best found so far. The result is that of a scan; centroids only decide how much is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.vectors import cosine_to
from shelfgraph.session import staged

SAMPLE = 10_000       # vectors that the centroids are fitted on
MOST_CELLS = 1_024
ROUNDS = 8
FILE_ROWS = 200_000
FIRST_ROWS = 2_000    # rows, or ten times the limit, that a search reads before it knows a score to beat
SLACK = 1e-6          # of an angle: far above rounding


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by k-means on unit vectors. The first are far apart: each is the sampled vector least like those before it."""
    found = [sample[0]]
    likeness = sample @ sample[0]
    for _ in range(min(cells, len(sample)) - 1):
        found.append(sample[int(likeness.argmin())])
        likeness = np.maximum(likeness, sample @ found[-1])
    centres = np.array(found)
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres


def _cell_rows(centres: np.ndarray):
    """Adds (cell, cosine to its centroid) to rows (id, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, centres.shape[1])
            cells, along = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for a in range(0, batch.num_rows, 1024):
                likeness = rows[a:a + 1024] @ centres.T / np.linalg.norm(rows[a:a + 1024], axis=1, keepdims=True)
                cells[a:a + 1024] = likeness.argmax(axis=1)
                along[a:a + 1024] = likeness.max(axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cells), pa.array(along)], ["id", "vector", "cell", "along"])

    return run


@dataclass(frozen=True)
class VectorCells:
    """``path/rows(id, vector)`` in folders by ``cell``, and ``path/cells(cell, centre, along, rows)``; ``along`` is the cell's smallest cosine."""

    spark: SparkSession
    path: str
    column: str
    schema: str

    @staticmethod
    def write(vectors: DataFrame, path: str, column: str, cells: int | None = None, sample: int = SAMPLE) -> VectorCells:
        """Index ``vectors(id, column)``. Rows without a vector, with a zero vector or of another length than most of the sample have no place in it."""
        rows = vectors.select("id", F.col(column).alias("vector")).filter(F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        rows = staged(rows, "vectors")
        picked = [r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
        sizes = [len(v) for v in picked]
        dims = max(set(sizes), key=sizes.count) if sizes else 0
        rows = rows.filter(F.size("vector") == dims)
        unit = np.array([v for v in picked if len(v) == dims], float).reshape(-1, max(dims, 1))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        count = rows.count()
        centres = centroids_of(unit, cells or min(MOST_CELLS, max(1, round(count ** 0.5)))) if count else np.ones((1, max(dims, 1)))
        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "vector")]
        placed = staged(rows.mapInArrow(_cell_rows(centres), ", ".join([*kinds, "cell int", "along double"])), "cells")
        files = 1 + count // FILE_ROWS
        placed.select("id", "vector", "cell").repartitionByRange(files, "cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        about = placed.groupBy("cell").agg(F.min("along").alias("along"), F.count("*").alias("rows"))
        listed = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        listed.join(about, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return VectorCells(rows.sparkSession, path, column, ", ".join([*kinds, "cell int"]))

    @staticmethod
    def open(spark: SparkSession, path: str, column: str) -> VectorCells:
        rows = spark.read.parquet(f"{path}/rows").schema
        return VectorCells(spark, path, column, ", ".join(f"{c} {rows[c].dataType.simpleString()}" for c in ("id", "vector", "cell")))

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids, angles and sizes of the cells: at most MOST_CELLS rows."""
        rows = self.spark.read.schema("cell int, centre array<double>, along double, rows long").parquet(f"{self.path}/cells").orderBy("cell").collect()
        centres = np.array([r.centre for r in rows], float)
        return np.array([r.cell for r in rows]), centres, np.arccos(np.clip([r.along for r in rows], -1, 1)), np.array([r.rows for r in rows])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select("id", F.col("vector").alias(self.column), "cell")

    def bounds(self, query: list[float]) -> np.ndarray:
        """The best cosine that a member of each cell can have with the query."""
        q = np.array(query, float)
        _, centres, angle, _ = self.cells
        own = np.arccos(np.clip(centres @ (q / np.linalg.norm(q)), -1, 1))
        return np.cos(np.maximum(0, own - angle - SLACK))

    def cells_to_read(self, query: list[float], limit: int, eligible: DataFrame | None = None) -> list[int]:
        """Cells that may hold one of the ``limit`` best eligible vectors. One job over the likeliest cells finds the score to beat."""
        if not len(self.cells[0]) or not any(query):
            return []
        if len(query) != self.cells[1].shape[1]:
            raise ValueError("the query and the indexed vectors have different lengths")
        number, _, _, size = self.cells
        bound = self.bounds(query)
        order = np.argsort(-bound, kind="stable")
        first = order[:int(np.searchsorted(np.cumsum(size[order]), max(FIRST_ROWS, 10 * limit))) + 1]
        rows = self.all().filter(F.col("cell").isin(number[first].tolist()))
        rows = rows if eligible is None else rows.join(eligible.select("id"), "id", "left_semi")
        score = rows.select(cosine_to(self.column, query).alias("s")).filter("s is not null").orderBy(F.col("s").desc()).limit(limit).collect()
        least = score[-1].s if len(score) == limit else -2.0
        return sorted(set(number[first].tolist()) | set(number[bound >= least - SLACK].tolist()))

    def near(self, query: list[float], limit: int, eligible: DataFrame | None = None) -> DataFrame:
        """(id, column) of the cells that may hold one of the ``limit`` best vectors, among ``eligible(id)`` if given."""
        return self.all().filter(F.col("cell").isin(self.cells_to_read(query, limit, eligible))).drop("cell")
