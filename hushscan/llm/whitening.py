"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, whose sums are exact.  The covariance matrix is
never formed: a pass over the table multiplies it with a thin block Q, as the
sum over rows of (x - mean) ((x - mean) Q), each row centred before it is
multiplied.  A Chebyshev polynomial of the covariance, one pass a degree,
damps every direction below the block's smallest Ritz value and lets those
above grow; QR and a Rayleigh-Ritz step follow, until the residuals of all
wanted pairs are at rounding level.  Only dim x block matrices reach the
driver, and those of the partitions are summed on the executors first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hushscan.llm.common import Scratch
from hushscan.llm.vectors import by_length

#: what an entry is multiplied by before it is cut to a whole number, and what is added then
SCALE, SHIFT = 1024, 100_000
#: larger entries have no place in a long
_LARGEST = float((1 << 62) // SCALE)
#: partial matrices are summed in so many tasks before they reach the driver
_SUMS = 16


@dataclass(frozen=True)
class Filter:
    """``components`` are wanted; ``guard`` more directions are carried along.

    A pass costs the same for any block up to some hundred directions, while a
    larger guard puts more distance between the wanted and the damped ones.
    ``degree`` is the most passes between two Rayleigh-Ritz steps; fewer are
    taken while the filter would grow one direction ``spread`` times more than
    another, beyond which rounding drowns the smaller one.
    """

    components: int = 8
    guard: int = 24
    degree: int = 10
    spread: float = 1e8
    tolerance: float = 1e-14
    rounds: int = 60


@dataclass(frozen=True)
class Whitening:
    """Eigenpairs of one vector length, largest first, and what they were fitted on."""

    dim: int
    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray  # dim x components
    trace: float
    residuals: np.ndarray
    largest: int
    passes: int = field(default=0)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.rows for s in self.sums])

    def rank(self) -> int:
        """Components whose variance is more than rounding leaves of zero."""
        return int((self.values > self.dim * np.finfo(float).eps * max(self.trace, 0.0)).sum())


def finite(vector: str) -> Column:
    """Not null, not empty, every entry there, finite and small enough for a long."""
    sound = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(_LARGEST)))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def whole_numbers(vector: str) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, (8 << 20) // (8 * dim))  # 8 MB of numbers at a time
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(-1, dim)


def _centred(x: np.ndarray, rows: int, sums: tuple[int, ...], largest: int) -> np.ndarray:
    """x - S / n, from the exact integer n x - S."""
    return _deviations(x, rows, sums, largest).astype(np.float64) / rows


def _deviations(x: np.ndarray, rows: int, sums: tuple[int, ...], largest: int) -> np.ndarray:
    """n x - S, in 64 bits where that holds them, else in Python's whole numbers."""
    if 2 * rows * largest < 1 << 62:
        return x * rows - np.array(sums, np.int64)
    return x.astype(object) * rows - np.array(sums, object)


def _summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all ``part`` matrices, added up on the executors before it is collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    gathered = partials.repartition(_SUMS).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r.part).reshape(shape) for r in gathered), np.zeros(shape))


class _Covariance:
    """Products of the covariance matrix with thin blocks: one distributed pass each."""

    def __init__(self, table: DataFrame, dim: int, rows: int, sums: tuple[int, ...], largest: int):
        self.table, self.dim, self.rows, self.sums, self.largest = table, dim, rows, sums, largest
        self.passes = 0

    def _pass(self, step, shape: tuple[int, ...]) -> np.ndarray:
        dim, rows, sums, largest = self.dim, self.rows, self.sums, self.largest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for _, x in _blocks(batches, dim):
                total += step(_centred(x, rows, sums, largest))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

        self.passes += 1
        return _summed(self.table.select("x").mapInArrow(run, "part binary"), shape) / rows

    def times(self, q: np.ndarray) -> np.ndarray:
        shared = self.table.sparkSession.sparkContext.broadcast(q)
        try:
            return self._pass(lambda c: c.T @ (c @ shared.value), q.shape)
        finally:
            shared.unpersist()

    def trace(self) -> float:
        return float(self._pass(lambda c: np.array([(c * c).sum()]), (1,))[0])


def _ritz(cov: _Covariance, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, vectors and residual norms of an orthonormal block, largest first."""
    product = cov.times(q)
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)
    return values, vectors, residuals


def _degree(values: np.ndarray, wanted: int, setting: Filter) -> int:
    """The most passes for which the largest direction does not outgrow the last wanted one."""
    edge = values[-1]
    grow = lambda v: np.arccosh(max(1.0, 2 * v / edge - 1))  # noqa: E731  T_m(x) = cosh(m arccosh x)
    ratio = grow(values[0]) - grow(values[wanted - 1])
    most = setting.degree if ratio <= 0 else int(np.log(setting.spread) / ratio)
    return max(2, min(setting.degree, most))


def _filtered(cov: _Covariance, q: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """T_degree((2 V - edge) / edge) q, scaled by its size at ``top`` in every step."""
    half = edge / 2
    sigma = first = half / (top - half)
    before, now = q, (cov.times(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - sigma)
        after = (cov.times(now) - half * now) * (2 * nxt / half) - (sigma * nxt) * before
        before, now, sigma = now, after, nxt
    return now


def _solve(cov: _Covariance, dim: int, setting: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wanted = min(setting.components, dim)
    width = min(dim, setting.components + setting.guard)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, width)))[0]
    values, vectors, residuals = _ritz(cov, q)
    best = np.inf
    for _ in range(setting.rounds):
        worst = residuals[:wanted].max()
        scale = max(values[0], 0.0)
        # certified; or as good as rounding lets it be, when another round has brought nothing
        if width == dim or worst <= setting.tolerance * scale or best <= 1e-12 * scale and worst > best / 2:
            break
        edge = values[-1]
        if edge <= dim * np.finfo(float).eps * scale:
            break  # the block already holds all directions with any variance
        best = min(best, worst)
        block = _filtered(cov, vectors, edge, scale, _degree(values, wanted, setting))
        values, vectors, residuals = _ritz(cov, np.linalg.qr(block)[0])
    if width < dim and residuals[:wanted].max() > 1e-10 * max(values[0], 0.0):
        raise RuntimeError(f"not converged: residuals {residuals[:wanted]} after {cov.passes} passes")
    return np.maximum(values[:wanted], 0.0), vectors[:, :wanted], residuals[:wanted]


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the fit list: whole numbers of all rows that ``finite`` lets in."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    return rows.where(finite("vector")).select("vec_id", whole_numbers("vector").alias("x"))


def fit(table: DataFrame, dim: int, setting: Filter = Filter()) -> Whitening:
    """The leading eigenpairs of the covariance of ``x``, all vectors of length ``dim``."""
    entries = table.select(F.posexplode("x").alias("at", "entry"))
    per_axis = entries.groupBy("at").agg(
        F.sum(F.col("entry").cast("decimal(20,0)")).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs("entry")).alias("largest"),
    )
    axes = per_axis.orderBy("at").collect()  # one row a dimension
    sums, rows, largest = tuple(int(a.total) for a in axes), axes[0].n, max(a.largest for a in axes)
    cov = _Covariance(table, dim, rows, sums, largest)
    values, basis, residuals = _solve(cov, dim, setting)
    return Whitening(dim, rows, sums, values, basis, cov.trace(), residuals, largest, cov.passes)


def whiten(table: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, n, deviation, whitened): the exact squared deviation and the whitened coordinates of every row.

    A component without variance has no scale; its coordinates are null.
    ``deviation`` is decimal(38,0).
    """
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rank = m.rank()
        basis = m.vectors[:, :rank] / np.sqrt(m.values[:rank])
        for part, x in _blocks(batches, m.dim):
            apart = _deviations(x, m.rows, m.sums, m.largest)
            # the sum of squares fits 64 bits only if dim x (2 n max)^2 does
            small = m.dim * (2 * m.rows * m.largest) ** 2 < 1 << 62
            exact = apart if small else apart.astype(object)
            squares = (exact * exact).sum(axis=1).tolist()
            spread = np.full((len(x), len(m.values)), np.nan)
            spread[:, :rank] = (apart.astype(np.float64) / m.rows) @ basis
            coordinates = [[v if k < rank else None for k, v in enumerate(row)] for row in spread.tolist()]
            sizes = [Decimal(s) if s < 10**38 else None for s in squares]
            made = [pa.array(sizes, pa.decimal128(38, 0)), pa.array(coordinates, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), *made], names=["vec_id", "deviation", "whitened"])

    kind = table.schema["vec_id"].dataType.simpleString()
    out = table.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumn("n", F.lit(model.rows).cast("long"))


def identity_error(table: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, from a pass over all rows.

    Null if no component has any variance.
    """
    rank, dim, rows, sums, largest = model.rank(), model.dim, model.rows, model.sums, model.largest
    if not rank:
        return None
    basis = model.vectors[:, :rank] / np.sqrt(model.values[:rank])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank + 1, rank))
        for _, x in _blocks(batches, dim):
            w = _centred(x, rows, sums, largest) @ basis
            total[:rank] += w.T @ w
            total[rank] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    moments = _summed(table.select("x").mapInArrow(run, "part binary"), (rank + 1, rank)) / rows
    centred = moments[:rank] - np.outer(moments[rank], moments[rank])
    return float(np.abs(centred - np.eye(rank)).max())


def whitened_components(vectors: DataFrame, setting: Filter = Filter(), *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold a null or non-finite entry or one
    of 2**52 or more, are dropped.  The rest are fitted by length, since
    vectors of different length share no axes; a length of fewer than
    ``setting.components`` dimensions has as many components as dimensions.
    Rows that repeat count each; null ids are kept.  Where the vectors do not
    vary along a component, whitened is null (explained is 0, or null if
    nothing varies).  ``deviation`` is decimal(38,0), null beyond 38 digits.
    An empty table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    table = scratch.write(prepared(vectors, vec_id, vector))
    parts = []
    for dim, part in by_length(table, "x"):
        model = fit(part, dim, setting)
        error = identity_error(part, model)
        shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
        rows = whiten(part, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        share = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at"))
        parts.append(rows.select(
            "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
            share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        ))
    if not parts:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
