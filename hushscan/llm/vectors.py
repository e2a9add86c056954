"""Vectors as packed matrices: what the embedding operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite and present, not all zero."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as float64 rows.

    Rows are scaled by powers of two, which changes no cosine and keeps sums
    of squares inside the range of doubles.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / norms[:, None], norms


def by_length(vectors: DataFrame, vector: str) -> list[tuple[int, DataFrame]]:
    """Vectors of different length are never near; one frame per length found."""
    lengths = [r[0] for r in vectors.select(F.size(vector)).distinct().collect()]
    return [(n, vectors.where(F.size(vector) == n)) for n in sorted(lengths)]


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Regroup a task's batches into tables of ``size`` rows; the last may be shorter."""
    waiting, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(size - rows, batch.num_rows)
            waiting.append(batch.slice(0, take))
            rows += take
            batch = batch.slice(take)
            if rows == size:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, rows = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def unpack(blob: bytes, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind).reshape(-1, dim)
