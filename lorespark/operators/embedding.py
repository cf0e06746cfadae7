"""Text to vector."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import terms
from lorespark.schemas import UNKNOWN_MODEL_DIMENSION
from lorespark.session import bounded_batches

Embedder = Callable[[Column], Column]

# Widths of well-known remote embedding models.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
}
# Counts that are held at a time while the vectors of a batch are made.
BAG_CELLS = 1 << 20


def model_dimension(model: str) -> int:
    return MODEL_DIMENSIONS.get(model, UNKNOWN_MODEL_DIMENSION)


def _buckets(terms: pa.Array, dim: int) -> np.ndarray:
    """Bucket of each term: the first 32 bits of its md5, modulo the width. Each distinct term is hashed once."""
    coded = terms.dictionary_encode()
    heads = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in coded.dictionary.to_pylist()]
    return (np.array(heads, np.int64) % dim)[coded.indices.to_numpy(zero_copy_only=False)]


def bag_vectors(terms: pa.Array, dim: int) -> pa.Array:
    """The vector of each list of terms: how many lie in each bucket, scaled to unit length."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    flat, ends, out = terms.flatten(), np.cumsum(lengths), []
    row, buckets = np.repeat(np.arange(len(terms)), lengths), _buckets(flat, dim) if len(flat) else np.zeros(0, np.int64)
    step = max(1, BAG_CELLS // dim)
    for start in range(0, len(terms), step):
        end = min(start + step, len(terms))
        own = slice(ends[start] - lengths[start], ends[end - 1])
        cells = (row[own] - start) * dim + buckets[own]
        counts = np.bincount(cells, minlength=(end - start) * dim).reshape(end - start, dim).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        out.append((counts / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32).ravel())
    values = np.concatenate([np.zeros(0, np.float32), *out])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * dim, pa.int32()), pa.array(values))


def hashed_bag(dim: int = 64) -> Embedder:
    """Embedder: term counts hashed into ``dim`` buckets, scaled to unit length.

    A text without terms gives the zero vector. Spark finds the terms; a batch of them is counted
    as arrays, so that a term is hashed once a batch and not wherever it stands.
    """

    def vectors(found: pa.Array) -> pa.Array:
        return bag_vectors(found, dim)

    counted = F.arrow_udf(vectors, "array<float>")
    return lambda text: counted(terms(text))


def embed(
    df: DataFrame,
    text_col: str = "content",
    embedder: Embedder | None = None,
    out: str = "embedding",
) -> DataFrame:
    """One vector per row, beside the row it belongs to.

    ``embedder`` maps a text column to an ``array<float>`` column: the hashed bag, or
    an iterator ``pandas_udf`` that loads a model once per worker.
    """
    bounded_batches(df.sparkSession)
    return df.withColumn(out, (embedder or hashed_bag())(F.col(text_col)))


def embed_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The same embedding for the ``text`` of a queries table."""
    return embed(queries, "text", embedder)


def check_dimension(
    vectors: DataFrame, dim: int, column: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` by vector width."""
    fits = F.coalesce(F.size(column) == dim, F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)
