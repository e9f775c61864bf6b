"""Whitening of embeddings by a one-sided Jacobi SVD of the triangle that a blockwise TSQR leaves.

1. Entries become whole numbers, and a task returns its count and exact sums per dimension; centring is exact, too:
   a row enters as n * x - S over n.
2. Each task factors its centred rows block by block, [R; block] = QR, and keeps R alone. The tasks' triangles are
   factored together, ``FAN_IN`` at a time, in levels of Spark tasks, until one is left: d x d numbers, whatever the rows.
3. Plane rotations orthogonalise the columns of R. Their lengths are the singular values of the centred rows, to a
   precision relative to each; the accumulated rotations are the components.
4. One pass measures the covariance of the whitened rows (counts, means and centred products, merged in the same levels);
   another returns them.

Defined results: a vector that is null, empty, holds a null or non-finite entry, or an entry whose whole number
doesn't fit 53 bits, is dropped, and so is one whose length isn't the most frequent (of two as frequent, the larger); ids may
be null or repeated, every remaining row has its own result rows; a component without variance (fewer rows than
dimensions, equal rows) has a null ``whitened`` and takes no part in ``identity_error``; ``explained`` is null where nothing
varies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage, trimmed
from factloom.llm.vectors import blocks, dimension, lists, matrix, usable

#: Components that are returned at most.
COMPONENTS = 32
#: Rows of a block that is factored at once, beside the triangle so far.
BLOCK_ROWS = 4096
#: Triangles or moments that one task of a level folds.
FAN_IN = 64
SCALE, SHIFT = 64, 1_000_000
_EXACT = 1 << 53
#: A singular value below this share of the largest is rounding.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Fit:
    """What one pass over the rows learns: n, the exact sums, components (columns), eigenvalues and their trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components that vary."""
        return int((self.eigenvalues > ROUNDING**2 * max(self.eigenvalues, default=0.0)).sum())

    def projection(self, components: int) -> np.ndarray:
        """Columns that take a centred row to its whitened values, for the components that vary."""
        k = min(components, self.rank)
        return self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def whole(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers: floor(64 c) + 1,000,000."""
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def clean(table: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id).alias("id"), v.alias("v")).filter(usable(F.col("v")) & F.forall("v", lambda x: F.abs(x) < float(_EXACT // (2 * SCALE))))
    width = dimension(rows, "v")
    return rows.filter(F.size("v") == width), width


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
    for batch in batches:
        x = whole(matrix(batch.column(0), width))
        n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), lists(high[None], pa.int64()), lists(low[None], pa.int64())], names=["n", "high", "low"])


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they do, else as Python's."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    kind = np.int64 if most < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, kind)[None, :]


def _triangle(batches: Iterator[pa.RecordBatch], n: int, sums: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One row: the R of all centred rows of the task."""
    width = len(sums)
    r = np.zeros((0, width))
    for table in blocks(batches, BLOCK_ROWS):
        rows = _centred(whole(matrix(table.column(0).chunk(0), width)), n, sums).astype(np.float64) / n
        r = np.linalg.qr(np.vstack([r, rows]), mode="r")
    yield _padded(r, width)


def _padded(r: np.ndarray, width: int) -> pa.RecordBatch:
    full = np.zeros((width, width))
    full[: len(r)] = r
    return pa.RecordBatch.from_arrays([lists(full.reshape(1, -1), pa.float64())], names=["r"])


def _refactor(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    r = np.zeros((0, width))
    for batch in batches:
        for one in matrix(batch.column(0), width * width):
            r = np.linalg.qr(np.vstack([r, one.reshape(width, width)]), mode="r")
    yield _padded(r, width)


def fold(rows: DataFrame, function, schema: str, label: str) -> DataFrame:
    """Fold a table of few, wide rows to one row: ``function`` takes the rows of a task to one row, level by level."""
    held = stage(rows, label)
    n = held.count()
    while n > 1:
        n = -(-n // FAN_IN)
        held = stage(held.repartition(n).mapInArrow(trimmed(function), schema), label)
    return held


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of a square matrix, by one-sided rotations.

    A round rotates disjoint pairs of columns at once; the rounds of a sweep meet every pair (one column stays, the others
    move round it). It ends when all pairs are orthogonal to working precision relative to their lengths.
    """
    width = r.shape[1]
    u, v = r.copy(), np.eye(width)
    order = list(range(width + width % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            p, q = np.array(order[: len(order) // 2]), np.array(order[: len(order) // 2 - 1 : -1])
            order = [order[0], order[-1], *order[1:-1]]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            a, b = (u[:, p] ** 2).sum(axis=0), (u[:, q] ** 2).sum(axis=0)
            c = (u[:, p] * u[:, q]).sum(axis=0)
            size = np.sqrt(a * b)
            worst = max(worst, float((np.abs(c) / np.where(size > 0, size, 1)).max(initial=0.0)))
            turn = np.abs(c) > 1e-16 * size
            if not turn.any():
                continue
            p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            for m in (u, v):
                m[:, p], m[:, q] = cos * m[:, p] - sin * m[:, q], sin * m[:, p] + cos * m[:, q]
        if worst <= width * np.finfo(float).eps:
            break
    lengths = np.sqrt((u**2).sum(axis=0))
    falling = np.argsort(-lengths, kind="stable")
    v = v[:, falling]
    return lengths[falling], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)


def fit(rows: DataFrame, width: int) -> Fit:
    """Components of the rows of ``clean``, of which there is at least one."""
    vectors = rows.select("v")
    total = vectors.mapInArrow(trimmed(lambda b: _sums(b, width)), "n long, high array<long>, low array<long>")
    each = total.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = sorted(each.agg(F.sum("n").alias("n"), wide("s.high").alias("high"), wide("s.low").alias("low")).collect())
    n, sums = got[0].n, tuple((int(g.high) << 32) + int(g.low) for g in got)
    r = fold(vectors.mapInArrow(trimmed(lambda b: _triangle(b, n, sums)), "r array<double>"), lambda b: _refactor(b, width), "r array<double>", "triangles")
    lengths, components = jacobi(np.array(r.first().r).reshape(width, width))
    eigenvalues = lengths**2 / n
    return Fit(n, sums, components, eigenvalues, float(eigenvalues.sum()))


def _whiten(batches: Iterator[pa.RecordBatch], fitted: Fit, components: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, n * x - S, whitened values) of each batch; a row's values depend on that row alone."""
    onto = fitted.projection(components)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            exact = _centred(whole(matrix(part.column("v"), len(fitted.sums))), fitted.n, fitted.sums)
            yield part, exact, np.einsum("ij,jk->ik", exact.astype(np.float64) / fitted.n, onto)


def _merged(one: tuple, two: tuple) -> tuple:
    """Counts, means and centred products of two parts as those of both."""
    (n, mean, products), (m, other, more) = one, two
    if not n or not m:
        return two if not n else one
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), products + more + np.outer(gap, gap) * (n * m / (n + m))


def _moments(parts: Iterator[tuple], k: int) -> pa.RecordBatch:
    total = (0, np.zeros(k), np.zeros((k, k)))
    for part in parts:
        total = _merged(total, part)
    n, mean, products = total
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), lists(mean[None], pa.float64()), lists(products.reshape(1, -1), pa.float64())], names=["n", "mean", "products"])


def identity_error(rows: DataFrame, fitted: Fit, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; None where nothing varies."""
    k = min(components, fitted.rank)
    if not k:
        return None
    schema = "n long, mean array<double>, products array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred = ((w, w.mean(axis=0)) for _, _, w in _whiten(batches, fitted, components))
        yield _moments(((len(w), m, (w - m).T @ (w - m)) for w, m in centred), k)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((n.as_py(), np.array(m.as_py()), np.array(p.as_py()).reshape(k, k)) for b in batches for n, m, p in zip(*b.columns, strict=True))
        yield _moments(each, k)

    total = fold(rows.select("v").mapInArrow(trimmed(measure), schema), again, schema, "moments").first()
    return float(np.abs(np.array(total.products).reshape(k, k) / total.n - np.eye(k)).max())


def whiten(table: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    spark = table.sparkSession
    rows, width = clean(table, id, vector)
    id_type = table.schema[id].dataType.simpleString()
    if not width:
        return spark.createDataFrame([], f"{id} {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    fitted = fit(rows, width)
    error, shown = identity_error(rows, fitted, components), min(components, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, exact, values in _whiten(batches, fitted, components):
            if exact.size and int(np.abs(exact).max()) ** 2 * width >= 1 << 62:
                deviation = pa.array([Decimal(int(d)) for d in (exact.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
            else:
                deviation = pa.array((exact**2).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column("id"), deviation, lists(values, pa.float64())], names=["id", "deviation", "w"])

    explained = F.array(*[F.lit(float(e / fitted.trace) if fitted.trace > 0 else None).cast("double") for e in fitted.eigenvalues[:shown]])
    out = rows.mapInArrow(trimmed(run), f"id {id_type}, deviation decimal(38,0), w array<double>")
    out = out.select("id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(shown))).alias("component"))
    return out.select(
        F.col("id").alias(id), F.col("component").cast("int"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"), F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
