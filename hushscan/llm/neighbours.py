"""Nearest neighbours by block matrix join.

Queries and candidates are packed into blocks; every query block meets every
candidate block in a tile.  A tile multiplies int8 codes, which bounds every
cosine from both sides; only pairs whose upper bound reaches the k-th best
lower bound are recomputed in double precision.  A heap per query merges the
tiles a task sees, a window merges the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.llm.vectors import by_length, chunks, matrix, unit, unpack, usable

BLOCK = 2048
_PACKED = "lane int, n int, ids binary, vectors binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each query row.

    The result is exact: bounds only decide what is recomputed.  Ties go to
    the smaller id; a query's own id is no candidate; fewer candidates than
    ``k`` give fewer rows.  Rows with a null id, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part; vectors
    of different length are not compared.  Rows that repeat an id and a vector
    count once.  Other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks")
    ).where(F.col("vec_id").isNotNull() & usable("vector"))
    found = [_search(part, dim, k) for dim, part in by_length(rows, "vector")]
    if not found:
        empty = rows.selectExpr("vec_id as query_id", "vec_id", "0D as score").where("false")
        found = [empty]
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = merged.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    cells = max(16, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    across = max(1, round((cells / 50) ** 0.5))  # lanes of queries, of which there are fewer
    down = -(-cells // across)
    queries = _packed(rows.where("asks"), across).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    queries = queries.select(
        F.struct(F.col("lane").alias("q"), F.col("other").alias("c")).alias("cell"),
        F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    candidates = _packed(rows, down).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    candidates = candidates.select(
        F.struct(F.col("other").alias("q"), F.col("lane").alias("c")).alias("cell"),
        F.col("n").alias("c_n"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"),
    )
    tiles = queries.hint("merge").join(candidates, "cell").select("q_ids", "q_vectors", "c_ids", "c_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heaps = None, {}
        for batch in batches:
            for q_ids, q_vectors, c_ids, c_vectors in zip(*(batch.column(i) for i in range(4))):
                if q_ids.as_py() != asked:
                    if heaps:
                        yield _flush(heaps)
                    asked, heaps = q_ids.as_py(), {}
                _tile(heaps, np.frombuffer(asked, np.int64), unpack(q_vectors.as_py(), dim),
                      np.frombuffer(c_ids.as_py(), np.int64), unpack(c_vectors.as_py(), dim), k)
        if heaps:
            yield _flush(heaps)

    return tiles.mapInArrow(run, "query_id long, vec_id long, score double")


def _packed(rows: DataFrame, lanes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for i, part in enumerate(chunks(batches, BLOCK)):
            ids = part.column("vec_id").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "lane": pa.array([(at + i) % lanes], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "vectors": pa.array([matrix(part.column("vector").combine_chunks()).tobytes()], pa.binary()),
                }
            )

    return rows.select("vec_id", "vector").mapInArrow(run, _PACKED)


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the norms of the coded part and of what it misses."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(units - coded, axis=1)


def _tile(heaps: dict, q_ids, q, c_ids, c, k: int) -> None:
    """Put the tile's k best of each query, at least, into the queries' heaps."""
    (q_unit, q_norm), (c_unit, c_norm) = unit(q), unit(c)
    q_codes, q_scale, q_size, q_lost = quantise(q_unit)
    c_codes, c_scale, _, c_lost = quantise(c_unit)
    kind = np.float32 if q.shape[1] * 127**2 < 2**24 else np.float64  # sums of products stay whole numbers
    right = c_codes.astype(kind).T
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        near = (q_codes[part].astype(kind) @ right).astype(np.float64)
        near *= q_scale[part, None] * c_scale
        bound = q_size[part, None] * c_lost + q_lost[part, None] + 1e-12
        low = near - bound
        low[q_ids[part, None] == c_ids] = -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        known = [heaps[i][0][0] if len(heaps.get(i, ())) == k else -np.inf for i in q_ids[part].tolist()]
        rows, cols = np.nonzero((near + bound >= np.maximum(kth, known)[:, None]) & (low > -np.inf))
        exact = (q[part][rows] * c[cols]).sum(axis=1) / (q_norm[part][rows] * c_norm[cols])
        for query, score, vec in zip(q_ids[part][rows].tolist(), exact.tolist(), c_ids[cols].tolist()):
            heap = heaps.setdefault(query, [])
            entry = (score, -vec)
            if entry in heap:
                continue
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _flush(heaps: dict) -> pa.RecordBatch:
    found = [(query, -vec, score) for query, heap in heaps.items() for score, vec in heap]
    return pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in found], _FOUND.field(i).type) for i in range(3)], schema=_FOUND
    )
