"""Vectors of whole numbers, held as doubles, and their exact inner products.

Scaled components of any size are whole doubles. Products that stay below 2**53 are exact in doubles;
beyond that they are taken in Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = 2.0**53


def whole(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as a double; null for a vector that takes no part."""
    known = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    # Whole doubles stay as they are; floor() would turn them into longs.
    floors = F.transform(
        vector,
        lambda x: F.when(F.abs(x.cast("double")) < 2.0**44, F.floor(x.cast("double") * factor).cast("double"))
        .otherwise(x.cast("double") * factor),
    )
    return F.when(known, floors)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    wide = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = values
    return out


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    bound = np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if bound < _EXACT:
        return vectors @ query
    whole_query = [int(x) for x in query]
    out = np.empty(len(vectors), dtype=object)
    for i, row in enumerate(vectors):
        out[i] = sum(int(a) * b for a, b in zip(row, whole_query))
    return out


def best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, ties by smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else (
        np.lexsort((ids, -scores))
    )
    return np.asarray(order[:count], dtype=int)
