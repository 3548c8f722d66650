"""Whitened leading components of vectors, by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the vectors gives its product with a narrow block of columns;
passes are joined by the Chebyshev recurrence, whose polynomial stays small on the unwanted part of the spectrum and
grows quickly beyond it. The filtered block is made orthonormal (QR), the best vectors in it are found
(Rayleigh-Ritz), and this goes on until their residuals certify them. The driver holds a few numbers per dimension.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.landing import batch, landed

SCALE = 256
COMPONENTS = 4
# Columns of the block beyond the wanted ones: the more, the further the unwanted spectrum lies off.
GUARD = 28
DEGREE = 12
# A polynomial that lifts the first component more than this above the damped ones would drown the others.
MAX_LIFT = 1e10
# Residuals, as a share of the largest eigenvalue. Below the second a residual that no longer falls is rounding.
CERTIFIED, ROUNDING = 1e-13, 1e-11
MAX_ROUNDS = 200
# Components with less than this share of the first one's variance are rounding.
RANK = 1e-12
SEED = 12

_CELLS = pa.schema([("cell", pa.int64()), ("part", pa.float64())])
_LONG_LIMIT = 9.0e18


@dataclass(frozen=True)
class Whitening:
    """``mean`` and ``directions`` (a unit column per component) over the fit list of ``n`` distinct vectors."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=np.float64)


# --- vectors


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c * SCALE))


def usable(docs: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose vector has only finite entries."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    rows = docs.select(F.col("vec_id").cast("bigint"), vector.alias("embedding")).where(vector.isNotNull() & finite)
    return rows.select("vec_id", whole_numbers(F.col("embedding")).alias("x"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _summed(fit: DataFrame, dimension: int, cells: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of what ``part`` makes of a batch of them: one pass, one partial sum per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for rows in batches:
            if rows.num_rows:
                total += part(_matrix(rows["x"], dimension)).ravel()
        yield batch(_CELLS, [np.arange(cells), total])

    sums = np.zeros(cells)
    summed = fit.select("x").mapInArrow(run, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    for row in summed.collect():
        sums[row["cell"]] = row["part"]
    return sums


# --- subspace iteration


def chebyshev(multiply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, bound: float, first: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``[0, bound]`` in the matrix, times the block; scaled so that ``first`` stays near 1."""
    half = bound / 2
    sigma = first_sigma = half / (first - half)
    before, now = block, (multiply(block) - half * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first_sigma - sigma)
        before, now = now, 2 * following / half * (multiply(now) - half * now) - sigma * following * before
        sigma = following
    return now


def _degree(bound: float, first: float) -> int:
    """As high as keeps the polynomial at the first eigenvalue below ``MAX_LIFT``."""
    growth = math.acosh(max(2 * first / bound - 1, 1 + 1e-9))
    return max(1, min(DEGREE, int(math.log(2 * MAX_LIFT) / growth)))


def leading_pairs(multiply: Callable[[np.ndarray], np.ndarray], dimension: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors, of a symmetric matrix without negative ones.

    Certified: every residual is at most 1e-13 of the first eigenvalue, or rounding keeps it from falling further.
    """
    wanted = min(components, dimension)
    width = min(dimension, wanted + GUARD)
    block, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, width)))
    least, stuck = math.inf, 0
    for _ in range(MAX_ROUNDS):
        image = multiply(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        first = float(values[0])
        if first <= 0:
            return np.zeros(0), np.zeros((dimension, 0))
        residual = float(np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max()) / first
        stuck = stuck + 1 if residual > least / 2 else 0
        least = min(least, residual)
        if residual <= CERTIFIED or (residual <= ROUNDING and stuck >= 2):
            return values[:wanted], block[:, :wanted] / np.linalg.norm(block[:, :wanted], axis=0)
        # The block's own least value bounds what the wanted ones are to be told from.
        bound = min(max(float(values[-1]), first * 1e-6), first * (1 - 1e-9))
        block, _ = np.linalg.qr(chebyshev(multiply, block, bound, first, _degree(bound, first)))
    raise RuntimeError(f"the components are not certified: residual {least:g}")


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``x``, one row per distinct vector, all of one length. None without a vector or without variance."""
    sizes = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, dimension = sizes[0], sizes[1]
    if not n or not dimension:
        return None
    exact = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in exact.orderBy("i").collect()]
    mean = np.array([s / n for s in sums], dtype=np.float64)

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(fit, dimension, block.size, part).reshape(block.shape) / n

    trace = float(_summed(fit, dimension, 1, lambda x: np.square(x - mean).sum(keepdims=True))[0]) / n
    values, directions = leading_pairs(multiply, dimension, components)
    kept = values > RANK * values[0] if len(values) else values > 0
    values, directions = values[kept], directions[:, kept]
    k = len(values)
    if not k:
        return None
    axes = directions / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ axes
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    found = _summed(fit, dimension, k + k * k, moments) / n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(n, sums, directions, values, values / trace, float(np.abs(covariance - np.eye(k)).max()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of ``(n * x - S) ** 2``, exactly; null beyond a bigint."""
    rough = np.square(n * x.astype(np.float64) - np.array(sums, dtype=np.float64)).sum(axis=1)
    if rough.max(initial=0) < _LONG_LIMIT / 2 and max((abs(s) for s in sums), default=0) < _LONG_LIMIT:
        return np.square(n * x - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


WHITE = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_WHITE = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
     *[(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]]
)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    An entry times 256, rounded down, is the whole number x that all is computed from. The components are fitted on
    each distinct vector once: ``n`` of them, with sums S. ``whitened`` is the centred vector on the component's unit
    vector over the square root of its variance, ``explained`` that variance's share of all, ``deviation`` the sum
    over dimensions of (n * x - S) squared (null beyond a bigint), ``identity_error`` the largest entry by which the
    covariance of the whitened fit list differs from the identity.

    Rows whose vector is null or empty, or holds a null or an entry that is not finite, are left out; so are those of
    another length than most vectors have (of equally many the longer). Rows that repeat come out as often, a null
    ``vec_id`` stays. Components without variance are left out, so vectors that are all the same, or an empty table,
    give no rows. Equal variances leave the choice of their components open; reruns start alike. Other columns than
    ``vec_id`` and ``embedding`` are not read. A vector that holds a third of all rows is counted before it is moved.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("m")).where("length > 0")
    most = lengths.agg(F.max(F.struct("m", "length")).alias("m")).first()["m"]
    if most is None:
        return spark.createDataFrame([], WHITE)
    dimension = most["length"]
    rows = rows.where(F.size("x") == dimension)
    model = fit_whitening(landed(rows.select("x").distinct(), "vectors"), components)
    if model is None:
        return spark.createDataFrame([], WHITE)
    mean, axes, k = model.mean, model.directions / np.sqrt(model.variances), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            m = part.num_rows
            if not m:
                continue
            x = _matrix(part["x"], dimension)
            white = (x - mean) @ axes
            ids, deviations = part["vec_id"].to_pylist(), _deviations(x, model.n, model.sums)
            yield batch(
                _WHITE,
                [
                    [v for v in ids for _ in range(k)], np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n),
                    [d for d in deviations for _ in range(k)], white.ravel(), np.tile(model.explained, m), np.full(m * k, model.identity_error),
                ],
            )

    return rows.mapInArrow(run, WHITE)
