"""Embedding whitening by Chebyshev-filtered subspace iteration.

Leading eigenvectors of the covariance are found without forming it: each pass
over the vectors returns XᵀXQ / n for centred X and a small block Q, summed in
the tasks and over a tree. A polynomial recurrence over such passes damps the
part of the spectrum that is not wanted; then come QR and Rayleigh-Ritz, until
the residuals certify the wanted pairs. A few more vectors than wanted are
iterated, whose smallest Ritz value is the upper end of what is damped. Its
lower end is taken from Lanczos steps of one more vector that rides along in the
first passes.

Values are integers; they are centred exactly (n * x - S) before anything is
multiplied, so an offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches, settle_table, table

COMPONENTS = 32
#: Entries of the vectors as integers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Vectors iterated beside the wanted ones, recurrence steps between two Rayleigh-Ritz steps at most, and Lanczos steps.
EXTRA, DEGREE, LANCZOS = 16, 10, 10
#: The growth of the largest eigenvalue over the damped ones in a recurrence, at most: beyond it rounding of the largest hides the others.
GROWTH = 1e9
#: Residuals, as a share of the largest eigenvalue, that certify the pairs; and rounds until a failure is reported.
RESIDUAL, ROUNDS = 1e-13, 200
#: Tasks' sums that the driver adds up; more are first added up in tasks.
FAN_IN = 64
#: Rows that a task turns into results at once.
ROWS = 1024


def finite(column: str = "embedding") -> Column:
    """Whether a vector is not null and all its entries are finite numbers."""
    return F.coalesce(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def as_integers(column: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of each entry in double precision; entries that no exact integer holds raise."""
    bad = F.raise_error(F.lit("an entry is too large for exact integers")).cast("long")
    return F.transform(column, lambda c: F.when(F.abs(c.cast("double")) * scale < 2.0**52, F.floor(c.cast("double") * scale).cast("long") + offset).otherwise(bad))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Centred:
    """The table (vec_id, x) with its number of rows n and its sums S, and the passes over it."""

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims = rows, dims

        def make():
            sums = {"n": 0, "s": np.zeros(dims, np.int64)}

            def step(batch):
                sums["n"] += batch.num_rows
                sums["s"] += _matrix(batch, dims).sum(axis=0)
                return iter(())

            step.finish = lambda: {"n": [sums["n"]], "s": [sums["s"].tolist()]}
            return step

        part = map_batches(rows.select("x"), "n long, s array<long>", make)
        found = sorted(map(tuple, part.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n"), F.sum("col"), F.count("*")).collect()))  # a row for each dimension
        self.n, self.tasks = (found[0][1], found[0][3]) if found else (0, 0)
        self.sums = np.array([x[2] for x in found], np.int64)

    def _sum(self, add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of add(centred rows), arrays of `size` doubles, over all batches: in each task, then in the order of the tasks."""
        dims, n, sums = self.dims, self.n, self.sums

        def make():
            total = np.zeros(size)

            def step(batch):
                nonlocal total
                total += add((n * _matrix(batch, dims) - sums) / n)
                return iter(())

            step.finish = lambda: {"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]}
            return step

        def add_up(parts: pa.Table) -> pa.Table:
            order = np.argsort(parts["part"].to_numpy())
            total = sum((np.frombuffer(parts["total"][int(k)].as_py()) for k in order), np.zeros(size))
            return pa.table({"part": pa.array([parts["part"][int(order[0])].as_py()], pa.int64()), "total": [total.tobytes()]})

        parts = map_batches(self.rows.select("x"), "part long, total binary", make)
        tasks = self.tasks
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            parts = parts.groupBy(F.pmod("part", F.lit(tasks))).applyInArrow(add_up, "part long, total binary")
        return sum((np.frombuffer(r["total"]) for r in sorted(parts.collect(), key=lambda r: r["part"])), np.zeros(size))  # FAN_IN rows at most

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q, by one pass."""
        return self._sum(lambda c: (c.T @ (c @ q)).ravel(), q.size).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self._sum(lambda c: np.array([(c * c).sum()]), 1)[0]) / self.n

    def whitened_covariance(self, p: np.ndarray) -> np.ndarray:
        return self._sum(lambda c: ((c @ p).T @ (c @ p)).ravel(), p.shape[1] ** 2).reshape(p.shape[1], -1) / self.n


class _Lanczos:
    """Steps of one vector, kept orthogonal; a bound below the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def next(self) -> np.ndarray:
        return self.basis[-1]

    def add(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        for _ in range(2):
            for b in self.basis:
                product = product - (b @ product) * b
        self.beta.append(float(np.linalg.norm(product)))
        self.basis.append(product / self.beta[-1] if self.beta[-1] > 0 else product)

    def ended(self) -> bool:
        return bool(self.beta) and self.beta[-1] <= 1e-12 * max(map(abs, self.alpha))

    def below(self) -> float:
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0])))


def _degree(top: float, low: float, high: float) -> int:
    """Recurrence steps such that the largest eigenvalue does not outgrow the damped ones by more than GROWTH."""
    x = max(1.0, (2 * top - high - low) / (high - low))
    rate = np.log(x + np.sqrt(x * x - 1)) if x > 1 else 0.0
    return int(np.clip(np.log(GROWTH) / rate, 2, DEGREE)) if rate > 0 else DEGREE


def leading(rows: Centred, wanted: int, extra: int = EXTRA, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of the covariance, falling, and their unit eigenvectors as columns, certified by residuals of at most residual * the largest."""
    dims = rows.dims
    q, rng = min(dims, wanted + extra), np.random.default_rng(dims)
    block = np.linalg.qr(rng.standard_normal((dims, q)))[0]
    probe, low = _Lanczos(rng.standard_normal(dims)), 0.0
    image = rows.times(block)
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        worst = float(np.linalg.norm(image - block * values, axis=0)[:wanted].max())
        if worst <= residual * max(values[0], 0.0) or values[0] <= 0:
            return values[:wanted], block[:, :wanted]
        high = float(values[-1])
        if high - low <= 1e-9 * values[0]:
            low = max(0.0, high - 0.1 * float(values[0]))
        if high <= low:
            high = low + 1e-9 * float(values[0])
        centre, half = (high + low) / 2, (high - low) / 2
        # the scaled recurrence of Chebyshev polynomials on [low, high], one pass a step; the first product is at hand
        scale = first = half / (float(values[0]) - centre)
        before, now = block, (image - centre * block) * (scale / half)
        for _ in range(_degree(float(values[0]), low, high) - 1):
            ride = len(probe.alpha) < LANCZOS and not probe.ended()
            product = rows.times(np.column_stack([now, probe.next()]) if ride else now)
            if ride:
                probe.add(product[:, -1])
                product = product[:, :-1]
            new = 1 / (2 / first - scale)
            before, now, scale = now, 2 * (new / half) * (product - centre * now) - scale * new * before, new
        if len(probe.alpha) >= LANCZOS or probe.ended():
            low = probe.below()
        block = np.linalg.qr(now)[0]
        image = rows.times(block)
    raise RuntimeError(f"no {wanted} certified components after {ROUNDS} rounds; the residual is {worst:.3g}")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error, for each usable vector and component.

    Vectors that are null or hold null or non-finite entries go. Of vectors of
    different length those of the most frequent length stay (of equally frequent
    ones the longest), as one covariance has one size. Components whose
    eigenvalue is zero to rounding cannot be whitened and are left out, so a
    table without two different vectors gives no rows, as an empty one does.
    Rows that repeat count each; a null vec_id stays. Other columns are not carried.
    """
    usable = vectors.where(finite() & (F.size("embedding") > 0))
    common = usable.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if common is None:
        return nothing
    dims = common["dims"]
    rows = Centred(settle_table(usable.where(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), as_integers("embedding", scale, offset).alias("x"))), dims)
    trace = rows.trace()
    values, basis = leading(rows, min(components, dims)) if trace > 0 else (np.empty(0), np.empty((dims, 0)))
    kept = values > trace * dims * np.finfo(float).eps
    values, basis = values[kept], basis[:, kept]
    if not len(values):
        return nothing
    project = basis / np.sqrt(values)
    error = float(np.abs(rows.whitened_covariance(project) - np.eye(len(values))).max())
    n, sums, r = rows.n, rows.sums, len(values)
    explained = values / trace

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                exact = n * _matrix(part, dims) - sums
                if (exact.astype(float) ** 2).sum(axis=1).max() >= 2.0**63:
                    raise OverflowError("a deviation does not fit 64 bits")
                k = part.num_rows
                yield {
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(k), r))), "component": pa.array(np.tile(np.arange(1, r + 1), k), pa.int32()), "n": pa.array(np.full(k * r, n)), "deviation": pa.array(np.repeat((exact * exact).sum(axis=1), r)),
                    "whitened": pa.array(((exact / n) @ project).ravel()), "explained": pa.array(np.tile(explained, k)), "identity_error": pa.array(np.full(k * r, error)),
                }

        return step

    return map_batches(rows.rows, schema, make)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
