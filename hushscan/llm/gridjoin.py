"""Embedding near-dedup by epsilon grid order join.

Two unit vectors have cosine >= t exactly when their distance is at most
eps = sqrt(2 - 2t).  Vectors are turned to principal axes, sorted by the cells
of an eps grid over the leading axes, and cut into blocks of the sequence.
Intervals of the sequence are joined recursively: a pair of intervals whose
bounding boxes are further apart than eps is skipped, any other is split,
down to pairs of blocks, which are compared as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushscan.llm.common import Scratch, components
from hushscan.llm.vectors import by_length, chunks, matrix, unit, unpack, usable

BLOCK = 2048
FANOUT = 8
PER_TASK = 4
#: axes the boxes know; what is beyond them is boxed by its length
AXES = 24
CELL_AXES = 3
_ROUNDING = 1e-9


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are all pairs of rows with cosine >= ``threshold`` in double
    precision.  Equal vectors are compared once, as a class.  Null, empty and
    zero vectors, and those with null or non-finite components, link with
    nothing and are their own component, as are rows without an id (component
    null, kept true); vectors of different length do not link.  Rows that
    repeat an id are vectors of their own.  Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("sound", F.col("vec_id").isNotNull() & usable("vector"))
    classes = scratch.write(
        rows.where("sound").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"))
    )
    pieces = [_links(part, dim, threshold, scratch) for dim, part in by_length(classes, "vector")]
    schema = "node long, links long, peer long"
    found = vectors.sparkSession.createDataFrame([], schema)
    for piece in pieces:
        found = found.unionByName(piece)
    found = scratch.write(found)
    labels = components(found.where("peer IS NOT NULL").selectExpr("node AS a", "peer AS b"), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.join(links, "node", "left")
        .join(labels, "node", "left")
        .select(
            "vector",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = rows.where("sound").join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Axes (columns) of falling variance; the moments come from all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                u = unit(matrix(batch.column("vector").slice(at, 4096)))[0]
                u = np.hstack([u, np.ones((len(u), 1))])
                total += u.T @ u
        flat = total.ravel()
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(flat)), pa.int32()), "v": pa.array(flat)})

    sums = classes.select("vector").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros((dim + 1) ** 2)
    for i, v in sums.collect():  # the square of the dimension, whatever the number of rows
        flat[i] = v
    moments = flat.reshape(dim + 1, dim + 1)
    mean = moments[:dim, dim] / max(moments[dim, dim], 1)
    spread = moments[:dim, :dim] / max(moments[dim, dim], 1) - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1].copy()


def _links(classes: DataFrame, dim: int, threshold: float, scratch: Scratch) -> DataFrame:
    eps = (2 - 2 * threshold) ** 0.5
    axes = principal_axes(classes, dim)
    boxed, cells = min(AXES, dim), min(CELL_AXES, dim)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.floor(unit(matrix(batch.column("vector")))[0] @ axes[:, :cells] / eps).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"node": batch.column("node"), "size": batch.column("size"), "vector": batch.column("vector")}
                    | {f"c{i}": pa.array(cell[:, i]) for i in range(cells)}
                )

    kind = classes.schema["vector"].dataType.simpleString()
    places = [f"c{i}" for i in range(cells)]
    located = classes.select("node", "size", "vector").mapInArrow(
        locate, f"node long, size long, vector {kind}, " + ", ".join(f"{c} int" for c in places)
    )
    wanted = max(1, classes.count() // (PER_TASK * BLOCK))
    ordered = located.repartitionByRange(wanted, *places, "node").sortWithinPartitions(*places, "node")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for i, part in enumerate(chunks(batches, BLOCK)):
            rows = matrix(part.column("vector").combine_chunks())
            low, high = box(unit(rows)[0] @ axes, boxed)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([at], pa.int64()),
                    "place": pa.array([i], pa.int64()),
                    "ids": pa.array([part.column("node").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "sizes": pa.array([part.column("size").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "vectors": pa.array([rows.tobytes()], pa.binary()),
                    "low": pa.array([low.tolist()], pa.list_(pa.float64())),
                    "high": pa.array([high.tolist()], pa.list_(pa.float64())),
                }
            )

    blocks = scratch.write(ordered.mapInArrow(
        pack, "part long, place long, ids binary, sizes binary, vectors binary, low array<double>, high array<double>"
    ))
    longest = blocks.agg(F.max("place")).first()[0] or 0
    blocks = blocks.withColumn("block", F.col("part") * (longest + 1) + F.col("place"))
    pairs = interval_pairs(blocks.select("block", "low", "high"), eps, scratch)
    left = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "sizes", "vectors")])
    right = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "sizes", "vectors")])
    tiles = pairs.join(left, "a").join(right, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                yield _compare(tile, dim, threshold)

    return tiles.mapInArrow(compare, "node long, links long, peer long")


def box(turned: np.ndarray, boxed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the leading axes and, last, on the length of the rest."""
    rest = np.linalg.norm(turned[:, boxed:], axis=1)
    known = np.column_stack([turned[:, :boxed], rest])
    return known.min(axis=0) - _ROUNDING, known.max(axis=0) + _ROUNDING


def interval_pairs(blocks: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """Pairs (a <= b, sure) of blocks that may hold vectors within ``eps``.

    Block numbers follow the sequence and make a tree: FANOUT neighbours are
    one interval of the next level.  From the root down, pairs of intervals
    whose boxes are within ``eps`` are split.  ``sure`` says that two blocks'
    boxes are so close that all their vectors are within ``eps``.
    """
    levels = [blocks.select(F.col("block").alias("id"), "low", "high")]
    last = blocks.agg(F.max("block")).first()[0] or 0
    while last:
        sides = (
            levels[-1]
            .select(F.expr(f"id div {FANOUT}").alias("id"), F.posexplode(F.arrays_zip("low", "high")).alias("axis", "s"))
            .groupBy("id", "axis")
            .agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
            .groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("s"))
        )
        levels.append(scratch.write(sides.select("id", F.col("s.low").alias("low"), F.col("s.high").alias("high"))))
        last //= FANOUT
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for depth, level in enumerate(reversed(levels)):
        if depth:
            child = F.expr(f"id div {FANOUT}")
            pairs = (
                pairs.join(level.select(child.alias("a"), F.col("id").alias("x")), "a")
                .join(level.select(child.alias("b"), F.col("id").alias("y")), "b")
                .where("x <= y")
                .select(F.col("x").alias("a"), F.col("y").alias("b"))
            )
        boxes = pairs.join(level.select(F.col("id").alias("a"), F.struct("low", "high").alias("l")), "a").join(
            level.select(F.col("id").alias("b"), F.struct("low", "high").alias("r")), "b"
        )
        gaps = boxes.select("a", "b", F.expr(_NEAR).alias("near"), F.expr(_FAR).alias("far"))
        near = gaps.where(F.col("near") <= eps * eps + 1e-6)
        pairs = scratch.write(near.select("a", "b", (F.col("far") <= eps * eps - 1e-6).alias("sure")))
    return pairs


#: squared distance of two boxes at least and at most; the last axis is a length
_NEAR = """aggregate(zip_with(zip_with(l.low, r.high, (x, y) -> x - y), zip_with(r.low, l.high, (x, y) -> x - y),
    (p, q) -> greatest(p, q, 0D)), 0D, (s, d) -> s + d * d)"""
_FAR = """aggregate(slice(zip_with(zip_with(l.high, r.low, (x, y) -> abs(x - y)), zip_with(r.high, l.low,
    (x, y) -> abs(x - y)), (p, q) -> greatest(p, q)), 1, size(l.low) - 1), 0D, (s, d) -> s + d * d)
    + pow(element_at(l.high, -1) + element_at(r.high, -1), 2D)"""


def _compare(tile: dict, dim: int, threshold: float) -> pa.RecordBatch:
    """Links between two blocks: counts for each vector and edges that span them."""
    same = tile["a"] == tile["b"]
    a, b = unpack(tile["a_vectors"], dim), unpack(tile["b_vectors"], dim)
    ids_a, ids_b = (np.frombuffer(tile[f"{s}_ids"], np.int64) for s in "ab")
    sizes_a, sizes_b = (np.frombuffer(tile[f"{s}_sizes"], np.int64) for s in "ab")
    offset = 0 if same else len(a)
    links = np.zeros(offset + len(b), np.int64)
    if tile["sure"]:
        links[: len(a)] += sizes_b.sum()
        if same:
            links -= sizes_b
        else:
            links[offset:] += sizes_a.sum()
        label = np.zeros(len(links), np.int64)
    else:
        (ua, na), (ub, nb) = unit(a), unit(b)
        fa, fb = ua.astype(np.float32), ub.astype(np.float32).T
        doubt = 1e-6 * max(8, dim)
        label = np.arange(len(links))
        for at in range(0, len(a), 256):
            near = fa[at : at + 256] @ fb
            rows, cols = np.nonzero(near >= threshold - doubt)
            value = near[rows, cols]
            rows += at
            check = np.nonzero(value < threshold + doubt)[0]
            exact = (a[rows[check]] * b[cols[check]]).sum(axis=1) / (na[rows[check]] * nb[cols[check]])
            keep = np.ones(len(rows), bool)
            keep[check[exact < threshold]] = False
            if same:
                keep &= rows != cols
            rows, cols = rows[keep], cols[keep]
            np.add.at(links, rows, sizes_b[cols])
            if not same:
                np.add.at(links, offset + cols, sizes_a[rows])
            label = spanned(label, rows, offset + cols)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    counted, joined = np.nonzero(links)[0], np.nonzero(label != np.arange(len(label)))[0]
    none = np.zeros(len(joined), np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "node": pa.array(np.concatenate([ids[counted], ids[joined]])),
            "links": pa.array(np.concatenate([links[counted], none])),
            "peer": pa.concat_arrays(
                [pa.nulls(len(counted), pa.int64()), pa.array(ids[label[joined]], pa.int64())]
            ),
        }
    )


def spanned(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the components after adding edges; a label is a member's index."""
    while True:
        a, b = label[left], label[right]
        if np.array_equal(a, b):
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
