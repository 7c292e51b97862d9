"""Embedding whitening: leading components by Jacobi-Davidson, with covariance products summed over a distributed fit list.

1. Every component of a vector becomes a whole number, ``floor(scale * c)``. The fit list holds each distinct vector once, packed in
   blocks of rows as numbers of 8 bytes. Sums per dimension are exact.
2. The covariance is never formed. A product with a block of directions is one pass: tasks centre the rows of their
   blocks, multiply, and add up a few numbers per dimension, which Spark sums.
3. Jacobi-Davidson on the driver holds only vectors of one number per dimension. Rayleigh-Ritz in the subspace gives the wanted
   pairs; for those not done, corrections come from the projected equations ``(I-ZZ')(V-e)(I-ZZ')t = -r``, solved by some steps
   of MINRES, side by side, so that one step is one pass for all. They extend the subspace, which restarts from its best
   vectors when it is large. A pair whose residual, from a fresh product, is at the rounding of the products is locked and projected out.
4. A last pass measures the covariance of the whitened fit list; the rows are projected where they are read.

Defined results: rows with null vectors or null or non-finite entries are dropped; so are vectors of another length than the most common
one (the longer of two equally common). Rows that share an id, or have none, come back each. Only components with a
variance above ``1e-12`` of the whole are returned, so fewer than asked where vectors span less, and no rows where all are
equal. A deviation too large for a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Steps, arrow

EPS = np.finfo(np.float64).eps
Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): the rows that take part, entries as whole numbers."""
    c = F.col("embedding").cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def pack(d: int, rows: int):
    """Blocks of at most so many rows, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype("<i8")
            for i in range(0, len(x), rows):
                yield arrow({"block": pa.binary()}, block=[x[i:i + rows].tobytes()])
    return run


class FitList:
    """The distinct vectors, in stored blocks, and passes over them."""

    def __init__(self, distinct: DataFrame, d: int, steps: Steps, rows: int = 4096) -> None:
        self.d = d
        self.blocks = steps.store(distinct.mapInArrow(pack(d, rows), "block binary"), "whiten-blocks")

        unpacked = self.rows

        def add(batches):
            for x in unpacked(batches, d):
                # Halves of the numbers, so that no partial sum overflows.
                yield arrow({"i": pa.int32(), "high": pa.int64(), "low": pa.int64()}, i=np.append(np.arange(d), d),
                            high=np.append((x >> 32).sum(axis=0), 0), low=np.append((x & 0xFFFFFFFF).sum(axis=0), len(x)))
        parts = self.blocks.mapInArrow(add, "i int, high long, low long").groupBy("i").agg(
            *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
        sums = {r.i: (int(r.high) << 32) + int(r.low) for r in parts}
        self.n = sums.pop(d, 0)
        self.sums = [sums.get(i, 0) for i in range(d)]
        self.mean = np.array([s / self.n if self.n else 0.0 for s in self.sums])

    @staticmethod
    def rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
        for batch in batches:
            for block in batch.column("block"):
                yield np.frombuffer(block.as_py(), "<i8").reshape(-1, d)

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all rows, centred, of ``size`` numbers; no task and no driver holds more than those."""
        unpacked, d, mean = self.rows, self.d, self.mean

        def run(batches):
            out = np.zeros(size)
            for x in unpacked(batches, d):
                out += of(x - mean).ravel()
            yield arrow({"i": pa.int32(), "v": pa.float64()}, i=np.arange(size), v=out)

        out = np.zeros(size)
        for i, v in self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[i] = v
        return out

    def product(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times each column."""
        k = directions.shape[1]
        return self.total(lambda c: c.T @ (c @ directions), self.d * k).reshape(self.d, k) / self.n


def minres(apply: Product, b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions of ``apply(x) = b``, each column a system of its own, all multiplied at once."""
    x = np.zeros_like(b)
    first = np.linalg.norm(b, axis=0)
    beta, left = first.copy(), first.copy()
    before, now, y = b, b, b
    old_beta = np.ones_like(beta)
    d_bar, eps_line, cos, sin = np.zeros_like(beta), np.zeros_like(beta), -np.ones_like(beta), np.zeros_like(beta)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    for step in range(steps):
        alive = beta > EPS * first
        if not (alive & (left > goal * first)).any():
            break
        v = np.where(alive, y / np.where(alive, beta, 1), 0.0)
        y = apply(v)
        if step:
            y = y - before * (beta / old_beta)
        alpha = (v * y).sum(axis=0)
        y = y - now * np.where(alive, alpha / np.where(alive, beta, 1), 0.0)
        before, now = now, y
        old_beta, beta = np.where(alive, beta, 1), np.linalg.norm(y, axis=0)
        old_eps = eps_line
        delta, gamma_bar = cos * d_bar + sin * alpha, sin * d_bar - cos * alpha
        eps_line, d_bar = sin * beta, -cos * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), EPS)
        cos, sin = gamma_bar / gamma, beta / gamma
        phi, left = cos * left, sin * left
        w, w_old = (v - old_eps * w_old - delta * w) / gamma, w
        x = x + np.where(alive, phi, 0.0) * w
    return x


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the other columns, which are orthonormal."""
    kept = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        column = column / size if size else column
        for _ in range(3):
            for basis in (*against, kept):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept = np.column_stack([kept, column])
    return kept


def jacobi_davidson(product: Product, d: int, wanted: int, rounding: float, inner: int = 6, guards: int = 8, most: int = 48,
                    rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, and their unit vectors as columns.

    A pair is done when its residual is at most ``rounding`` of the largest eigenvalue. ``guards`` further pairs are followed, as a
    pass costs the same for them, and they keep near eigenvalues apart.
    """
    wanted = min(wanted, d)
    guard = min(wanted + guards, d)
    basis = orthonormal(np.random.default_rng(13).standard_normal((d, guard)))
    image = product(basis)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    for _ in range(rounds):
        inside = basis.T @ image
        ritz, turn = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(-ritz)
        ritz, turn = ritz[order], turn[:, order]
        basis, image = basis @ turn, image @ turn
        active = min(guard - len(values), basis.shape[1])
        top = max(values.max(initial=0.0), ritz[0])
        residual = image[:, :active] - basis[:, :active] * ritz[:active]
        size = np.linalg.norm(residual, axis=0)
        if size[0] <= rounding * top:
            # Locked in order of their values, on a product that no restart has touched.
            image[:, :active] = product(basis[:, :active])
            ritz[:active] = (basis[:, :active] * image[:, :active]).sum(axis=0)
            residual = image[:, :active] - basis[:, :active] * ritz[:active]
            size = np.linalg.norm(residual, axis=0)
            done = int(np.cumprod(size[:wanted - len(values)] <= rounding * top).sum())
            locked, values = np.column_stack([locked, basis[:, :done]]), np.append(values, ritz[:done])
            basis, image, ritz, residual = basis[:, done:], image[:, done:], ritz[done:], residual[:, done:]
            active -= done
            if len(values) == wanted:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
        active = max(1, active)
        if basis.shape[1] + active > most:
            basis, image = basis[:, :most // 3], image[:, :most // 3]
        out = np.column_stack([locked, basis[:, :active]])
        shifts = ritz[:active]

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - out @ (out.T @ t)
            t = product(t) - t * shifts
            return t - out @ (out.T @ t)

        right = -(residual[:, :active] - out @ (out.T @ residual[:, :active]))
        new = orthonormal(minres(projected, right, inner, 1e-2), locked, basis)
        if not new.shape[1]:  # the corrections lie in the subspace already: take any direction left
            new = orthonormal(np.random.default_rng(len(values)).standard_normal((d, 1)), locked, basis)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"{len(values)} of {wanted} components settled in {rounds} rounds")


def projected_rows(d: int, n: int, mean: np.ndarray, values: np.ndarray, axes: np.ndarray, trace: float, error: float):
    kinds = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(),
             "explained": pa.float64(), "identity_error": pa.float64()}
    k = len(values)
    scaled = axes / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield arrow(kinds, vec_id=batch.column("vec_id").take(row), component=np.tile(np.arange(1, k + 1), len(x)),
                        n=np.full(len(row), n), deviation=batch.column("deviation").take(row), whitened=((x - mean) @ scaled).ravel(),
                        explained=np.tile(values / trace, len(x)), identity_error=np.full(len(row), error))
    return run


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row on each leading component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or not common.d:
        return spark.createDataFrame([], schema)
    d = common.d
    rows = rows.where(F.size("x") == d)
    with Steps(spark) as steps:
        fit = FitList(rows.select("x").distinct(), d, steps)
        trace = float(fit.total(lambda c: np.array([(c * c).sum()]), 1)[0]) / fit.n
        rounding = EPS * (16 * np.sqrt(d) + 4 * np.log2(fit.n + 1))
        values, axes = jacobi_davidson(fit.product, d, components, rounding) if trace else (np.zeros(0), np.zeros((d, 0)))
        real = values > 1e-12 * trace
        values, axes = values[real], axes[:, real]
        k = len(values)
        error = 0.0
        if k:
            scaled = axes / np.sqrt(values)
            moments = fit.total(lambda c: np.vstack([(c @ scaled).T @ (c @ scaled), (c @ scaled).sum(axis=0)]), k * k + k) / fit.n
            square, mean = moments[:k * k].reshape(k, k), moments[k * k:]
            error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
        steps.drop(fit.blocks)
    # One number per dimension: the exact sums, as literals of the plan.
    far = [abs(s) >= 2**63 for s in fit.sums]
    sums = F.array(*(F.lit(None if big else s).cast("long") for s, big in zip(fit.sums, far)))
    moved = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(fit.n).cast("long")), s))
    deviation = F.aggregate(moved, F.lit(0).cast("long"), lambda total, m: F.try_add(total, F.try_multiply(m, m)))
    return rows.select("vec_id", "x", deviation.alias("deviation")).mapInArrow(
        projected_rows(d, fit.n, fit.mean, values, axes, trace, error), schema)
