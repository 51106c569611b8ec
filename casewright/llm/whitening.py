"""Whitening of vectors on their leading principal components, found by spectrum slicing.

Entries c become whole numbers floor(64 * c), so counts and sums are exact and the same at every partitioning. Three passes run over
the rows: sums, products centred on the whole number next to the mean, and the projection; a fourth reads the projections for the
covariance that proves them white. Each task hands on sums of the size of the covariance matrix, which Spark adds up; no vector is shuffled.

The covariance then stands as correctly rounded doubles. LDL' factors of the covariance less a shift tell by their inertia how
many eigenvalues lie below the shift; bisection by these counts isolates each leading eigenvalue, Rayleigh quotient iteration converges to
it, and two more counts, just below and just above, certify its number. Eigenvalues that cannot be told apart share an interval
and are taken one after another, each orthogonal to those before.

Vectors that are null, empty, hold null or non-finite entries, or entries beyond 2**25 (whose deviation no long could hold) take no part. If lengths
differ, the vectors of the most common length (the longer at a tie) are the fit list, the others take no part. A null id is an id like any other;
repeated rows each count and each give rows. Eigenvalues below 1e-12 of the largest are zero to double precision and no
components, so vectors that are all alike, or one alone, give no rows, nor does an empty table. A deviation beyond a long is null.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.tables import materialise

GRID = 64
COMPONENTS = 32
#: Whole numbers beyond this take no part.
LARGEST = 1 << 31
#: Eigenvalues below this share of the largest count as zero.
FLOOR = 1e-12
EXACT = 1 << 53
SEED = 42
_EPS = float(np.finfo(np.float64).eps)


class Spectrum(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column for each value
    trace: float


def grid_vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the usable vectors of each length, and their whole numbers as a matrix of doubles."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        x = flat[starts[at][:, None] + np.arange(dim)]
        with np.errstate(invalid="ignore"):
            x = np.floor(GRID * x)
            sound = (np.abs(x) <= LARGEST).all(axis=1)
        yield at[sound], x[sound]


def of_length(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return next(((at, x) for at, x in grid_vectors(lists) if x.shape[1] == dim), (np.zeros(0, np.int64), np.zeros((0, dim))))


def whole_products(z: np.ndarray) -> np.ndarray:
    """z.T @ z of whole numbers below 2**33, without rounding, as Python's whole numbers."""
    out = np.zeros((z.shape[1],) * 2, dtype=object)
    if not z.size:
        return out
    most = max(1.0, float(np.abs(z).max()))
    if most * most < EXACT / 1024:
        step = int(EXACT / (most * most))
        for a in range(0, len(z), step):
            out += (z[a : a + step].T @ z[a : a + step]).astype(np.int64).astype(object)
        return out
    high = np.floor(z / 65536)
    low = z - 65536 * high
    for a in range(0, len(z), 1 << 16):
        h, k = high[a : a + (1 << 16)], low[a : a + (1 << 16)]
        hh, hk, kk = ((p.T @ q).astype(np.int64).astype(object) for p, q in ((h, h), (h, k), (k, k)))
        out += hh * (1 << 32) + (hk + hk.T) * (1 << 16) + kk
    return out


def length_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, n and the sums of every place, for each length among this task's vectors."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in grid_vectors(batch.column(0)):
            entry = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            entry[0] += len(x)
            entry[1] += x.astype(np.int64).sum(axis=0)
    dims = sorted(d for d, (n, _) in found.items() if n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(dims, pa.int32()), pa.array([found[d][0] for d in dims], pa.int64()), pa.array([found[d][1] for d in dims], pa.list_(pa.int64()))],
        names=["dim", "n", "sums"],
    )


def _upper(matrix: np.ndarray, values: pa.Array) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "value"])


def centred_products(dim: int, centre: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            total += whole_products(of_length(batch.column(0), dim)[1] - centre)
        values = [Decimal(v) for v in total[np.triu_indices(dim)]]
        yield _upper(total, pa.array(values, pa.decimal128(38, 0)))

    return run


def white_products(width: int) -> Callable:
    """Sums (last row and column) and products of the projections of this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        yield _upper(total, pa.array(total[np.triu_indices(width + 1)], pa.float64()))

    return run


def negative_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are below zero: the inertia of its LDL' factors (pivots by Bunch and Kaufman)."""
    a, k, below = matrix.copy(), 0, 0
    n, alpha = len(a), (1 + math.sqrt(17)) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max() if len(column) else 0.0
        pair = False
        if most > 0 and abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                pair = abs(a[r, r]) < alpha * row.max()
                swap(k + pair, r)
        if pair:
            block, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            below += 1  # such a block has one eigenvalue on each side
            k += 2
        else:
            below += a[k, k] < 0
            if most > 0:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            k += 1
    return int(below)


class Slicer:
    """Counts of eigenvalues from a shift up, each taken once."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.known = matrix, {}

    def at_least(self, shift: float) -> int:
        if shift not in self.known:
            d = len(self.matrix)
            self.known[shift] = d - negative_pivots(self.matrix - shift * np.eye(d))
        return self.known[shift]

    def slices(self, low: float, high: float, wanted: int, width: float) -> list[tuple[float, float, int]]:
        """Intervals (low, high, eigenvalues inside), from the top, that hold the wanted leading eigenvalues between low and high: of one
        eigenvalue each, or no wider than width."""
        out, todo = [], [(low, high)]
        while todo:
            a, b = todo.pop()
            inside = self.at_least(a) - self.at_least(b)
            if not inside or self.at_least(b) >= wanted:
                continue
            middle = (a + b) / 2
            if inside == 1 or b - a <= width or not a < middle < b:
                out.append((a, b, inside))
            else:
                todo += [(a, middle), (middle, b)]
        return sorted(out, reverse=True)


def _rayleigh(matrix: np.ndarray, shift: float, known: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration, orthogonal to known: eigenvalue, vector, residual. Its first two steps keep the shift."""
    d, scale = len(matrix), float(np.abs(matrix).sum(axis=0).max())
    x, best = start, (shift, start, math.inf)
    for step in range(12):
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x / np.linalg.norm(x)
        if step:
            rho = float(x @ matrix @ x)
            residual = float(np.linalg.norm(matrix @ x - rho * x))
            if step > 2 and residual >= best[2]:
                break
            best = (rho, x, residual)
            shift = rho if step >= 2 else shift
        shifted = matrix - shift * np.eye(d)
        try:
            x = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:
            x = np.linalg.solve(shifted + _EPS * scale * np.eye(d), x)
    return best


def leading_spectrum(matrix: np.ndarray, wanted: int = COMPONENTS) -> Spectrum:
    """The leading eigenpairs of a covariance, their numbers certified by counts."""
    d, trace = len(matrix), float(np.trace(matrix))
    scale = float(np.abs(matrix).sum(axis=0).max())
    if not scale > 0:
        return Spectrum(np.zeros(0), np.zeros((d, 0)), trace)
    slicer, rng = Slicer(matrix), np.random.default_rng(SEED)
    low, high = FLOOR * scale, scale * (1 + 1e-6)
    wanted = min(wanted, slicer.at_least(low))
    values, vectors, residuals = [], np.zeros((d, 0)), []
    for a, b, inside in slicer.slices(low, high, wanted, 64 * _EPS * scale):
        for _ in range(inside):
            while True:
                rho, x, residual = _rayleigh(matrix, (a + b) / 2, vectors, rng.standard_normal(d))
                slack = max(8 * residual, 64 * _EPS * scale)
                middle = (a + b) / 2
                if a - slack <= rho <= b + slack or inside > 1 or b - a <= slack or not a < middle < b:
                    break
                a, b = (middle, b) if slicer.at_least(middle) > slicer.at_least(b) else (a, middle)
            values.append(rho)
            vectors = np.column_stack([vectors, x])
            residuals.append(residual)
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    for number, at in enumerate(order, 1):
        slack = max(8 * residuals[at], 64 * _EPS * scale)
        if slicer.at_least(values[at] - slack) < number or slicer.at_least(values[at] + slack) >= number:
            raise ArithmeticError(f"eigenvalue {number} is not where the counts put it")
    return Spectrum(np.array(values)[order], vectors[:, order], trace)


def covariance(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance with divisor n from whole sums and products of the same centred numbers: each entry rounded once."""
    out = np.zeros((len(sums),) * 2)
    for (i, j), v in products.items():
        out[i, j] = out[j, i] = (n * v - sums[i] * sums[j]) / (n * n)
    return out


def projector(dim: int, n: int, sums: list[int], axes: np.ndarray) -> Callable:
    """Rows (vec_id, vector) to (vec_id, deviation, w)."""
    wide = n * LARGEST * 2 >= 1 << 62
    total = np.array(sums, dtype=object if wide else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = of_length(batch.column(1), dim)
            away = n * x.astype(np.int64).astype(total.dtype) - total
            size = (away.astype(np.float64) ** 2).sum(axis=1)
            if not wide and (not len(size) or size.max() < 9e18):
                deviation = (away * away).sum(axis=1).tolist()
            else:
                exact = (sum(v * v for v in row) for row in away.tolist())
                deviation = [v if v < 1 << 63 else None for v in exact]
            w = (away.astype(np.float64) / n) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * axes.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))],
                names=["vec_id", "deviation", "w"],
            )

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    At the driver is what is known of all rows together: sums and products of the vectors' places, never more than a covariance."""
    vector = F.col(vector_col).cast("array<double>").alias("v")
    lengths = materialise(rows.select(vector).mapInArrow(length_sums, "dim int, n long, sums array<long>"), "white-sums")
    common = lengths.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    empty = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if common is None:
        return empty
    dim, n = common
    by_place = lengths.where(F.col("dim") == dim).select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(28,0)")))
    sums = [int(s) for _, s in sorted(by_place.collect())]
    centre = [round(s / n) for s in sums]
    products = rows.select(vector).mapInArrow(centred_products(dim, np.array(centre, np.float64)), "i int, j int, value decimal(38,0)")
    whole = {(i, j): int(v) for i, j, v in products.groupBy("i", "j").agg(F.sum("value")).collect()}
    found = leading_spectrum(covariance(n, [s - n * c for s, c in zip(sums, centre)], whole), components)
    width = len(found.values)
    if not width:
        return empty
    axes = found.vectors / np.sqrt(found.values)
    white = materialise(rows.select(F.col(id_col).cast("long").alias("vec_id"), vector).mapInArrow(projector(dim, n, sums, axes), "vec_id long, deviation long, w array<double>"), "white-rows")
    moments = np.zeros((width + 1, width + 1))
    for i, j, v in white.select("w").mapInArrow(white_products(width), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        moments[i, j] = moments[j, i] = v
    mean = moments[width, :width] / n
    error = float(np.abs(moments[:width, :width] / n - np.outer(mean, mean) - np.eye(width)).max())
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(int(n)).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
