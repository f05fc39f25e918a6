"""Vector columns as native array expressions; the components of hash embeddings are made by NumPy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.functions.text import col


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_doubles(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; null for a null or zero vector or for different lengths."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(col(a)) == F.size(col(b)), F.try_divide(dot(a, b), lengths))


def cosine_to(v, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector, whose length is divided out beforehand."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if length == 0:
        return F.lit(None).cast("double")
    along = dot(v, vector_literal(x / length for x in query))
    return F.when(F.size(col(v)) == len(query), F.try_divide(along, F.sqrt(dot(v, v))))


def unit_score(cos: Column) -> Column:
    """Cosine mapped to 0..1."""
    return (1 + cos) / 2


def truncate(v, dims: int) -> Column:
    """Leading ``dims`` components, not rescaled; fails on a vector that is too short."""
    if dims <= 0:
        raise ValueError("dims must be positive")
    too_short = F.concat(F.lit(f"cannot take {dims} dimensions of "), F.size(col(v)).cast("string"))
    return F.when(F.size(col(v)) < dims, F.raise_error(too_short).cast("array<float>")).otherwise(F.slice(col(v), 1, dims))


def fit(v, dims: int) -> Column:
    """Exactly ``dims`` components: cut, or padded with zeros."""
    return F.slice(F.concat(as_doubles(v), F.array_repeat(F.lit(0.0), dims)), 1, dims)


HASH_ROWS = 1_000  # vectors that a task hands over at a time


def hash_embedding(text, dims: int = 1536) -> Column:
    """Deterministic vector of a text from the hex digits of six SHA-256 digests, used in a cycle; null for null.

    Spark makes the digests; the components are made of them a batch at a time, as array lambdas would be evaluated one by one.
    """
    digests = F.concat(*[F.sha2(F.concat(col(text), F.lit(str(i))), 256) for i in range(6)])
    place = np.arange(dims)
    values = np.full(128, np.nan)
    values[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16) / 15.0

    def vectors(digits: pa.Array) -> pa.Array:
        known = digits.drop_null()
        codes = np.frombuffer("".join(known.to_pylist()).encode(), np.uint8).reshape(len(known), 384)
        rows = values[codes[:, place % 384]] - 0.5 + ((place % 100) / 10000.0 - 0.005) if len(known) else np.zeros((0, dims))
        ends = np.concatenate([[0], np.cumsum(digits.is_valid().to_numpy(zero_copy_only=False))]) * dims
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()), mask=digits.is_null())

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def components(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for digits in batches:
            for at in range(0, len(digits), HASH_ROWS):
                yield vectors(digits.slice(at, HASH_ROWS))

    return components(digests)


def embedding_text(title, genre) -> Column:
    """Text an embedding is computed from: title, then genre when there is one."""
    return F.concat_ws(" ", col(title), F.nullif(col(genre), F.lit("")))
