"""Embedding whitening: principal components by a block Jacobi-Davidson method.

The covariance is never formed. ``products`` gives it times a narrow matrix, in one pass over
the stored vectors: a task centres its vectors (whole numbers off the rounded mean exactly,
then the mean's fraction), multiplies, and sends a matrix of the width that it was given. All
unconverged components share a pass.

Each round, Rayleigh-Ritz over the subspace gives Ritz pairs. Those whose residual has reached
double precision are locked and leave the subspace. For the others the projected correction
equations (I - UU')(V - theta I)(I - UU') t = -r are solved by some steps of MINRES, in step
with each other, and t extends the subspace. The driver holds matrices of a vector's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import small_batches, stored
from catchment.llm.topk import integers

#: Steps of MINRES a round; rounds until it gives up; residual, in units of the largest eigenvalue, that ends a component.
INNER, TURNS, EXACT = 4, 60, 64 * np.finfo(np.float64).eps
#: Share of the trace below which a component counts as without variance.
FLAT = 1e-12
#: Partitions whose sums go straight to the driver; more are added up in as many groups first.
GROUPS = 256
Product = Callable[[np.ndarray], np.ndarray]


def lattice(embedding: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> F.Column:
    """floor(scale * c) + offset of each component as long; null if the vector is null or empty,
    or a component is null or not finite."""
    return F.transform(integers(F.col(embedding), scale), lambda x: x + offset)


def packed(fit: DataFrame) -> DataFrame:
    """n, x (binary, 64-bit): blocks of the vectors (x array<long>, of one length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([batch.column(0).flatten().to_numpy().tobytes()], pa.binary())], names=["n", "x"])

    return fit.select("x").mapInArrow(run, "n int, x binary")


def summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type = np.float64, many: bool = False) -> np.ndarray:
    """The sum over all ``blocks`` of ``of`` (their vectors as rows), an array of ``shape``;
    ``many``: they are more partitions than the driver should add up.

    Sums are taken in a fixed order, so equal tables give equal results."""
    size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for n, x in zip(*batch.columns, strict=True):
                total += of(np.frombuffer(x.as_buffer(), np.int64).reshape(n.as_py(), -1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "total": [sum(np.frombuffer(t, kind) for t in rows["total"]).tobytes()]})

    parts = blocks.mapInArrow(run, "part int, total binary")
    if many:
        parts = parts.groupBy(F.col("part") % GROUPS).applyInPandas(add, "part int, total binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])  # GROUPS or so at most
    return sum((np.frombuffer(r["total"], kind).reshape(shape) for r in rows), np.zeros(shape, kind))


def orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what ``t`` has beyond ``bases``; directions of rounding alone are left out."""
    for _ in range(3):
        t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
        for b in bases:
            t = t - b @ (b.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, s > 1e-10]
    for b in bases:
        u = u - b @ (b.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(apply: Product, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system for each column of ``b``, in step."""
    norm = lambda m: np.linalg.norm(m, axis=0)
    over = lambda m, d: np.divide(m, d, out=np.zeros_like(m), where=d > 0)
    beta = norm(b)
    v, before = over(b, np.broadcast_to(beta, b.shape)), np.zeros_like(b)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, c, c_before, s, s_before = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        new = norm(p)
        delta, rho2, rho3 = c * alpha - c_before * s * beta, s * alpha + c_before * c * beta, s_before * beta
        rho1 = np.hypot(delta, new)
        w, w_before = over(v - rho3 * w_before - rho2 * w, np.broadcast_to(rho1, v.shape)), w
        c_before, s_before, c, s = c, s, over(delta, rho1), over(new, rho1)
        x = x + c * eta * w
        eta = -s * eta
        v, before, beta = over(p, np.broadcast_to(new, p.shape)), v, new
    return x


def ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and their products, of the subspace q with products w."""
    h = q.T @ w
    theta, y = np.linalg.eigh((h + h.T) / 2)
    y = y[:, ::-1]
    return theta[::-1], q @ y, w @ y


def jacobi_davidson(apply: Product, dim: int, want: int, inner: int = INNER, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``want`` largest eigenvalues, their unit eigenvectors as columns, and the largest
    residual norm in units of the largest eigenvalue, of the operator ``apply``.

    Fails if residuals don't reach double precision in TURNS rounds."""
    want = min(want, dim)
    most = min(dim, 3 * want + 16)  # columns of the subspace before it is cut back
    values, locked = np.zeros(0), np.zeros((dim, 0))
    q = orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, want + 4))))
    w = apply(q)
    for _ in range(TURNS):
        theta, u, au = ritz(q, w)
        top = max([*values[:1], *theta[:1], 0.0])
        open_ = want - len(values)
        r = au[:, :open_] - u[:, :open_] * theta[:open_]
        done = np.linalg.norm(r, axis=0) <= EXACT * top
        lead = int(np.argmin(done)) if not done.all() else len(done)  # only the leading ones: order stays right
        values, locked = np.r_[values, theta[:lead]], np.c_[locked, u[:, :lead]]
        if len(values) == want:
            w = apply(locked)  # what is returned is held against a pass of its own
            worst = np.linalg.norm(w - locked * values, axis=0).max() / top if top > 0 else 0.0
            order = np.argsort(-values, kind="stable")
            if worst <= 4 * EXACT:
                return values[order], locked[:, order], worst
            q, values, locked = orthonormal(locked), np.zeros(0), np.zeros((dim, 0))
            w = apply(q)
            continue
        q, w, theta, r = u[:, lead:], au[:, lead:], theta[lead:], r[:, lead:]
        if q.shape[1] + r.shape[1] > most - len(values) and q.shape[1] > open_:
            keep = max(open_ - lead + 4, most - len(values) - r.shape[1])
            q, w, theta = q[:, :keep], w[:, :keep], theta[:keep]
        wide = np.c_[locked, q[:, : r.shape[1]]]
        away = lambda t: t - wide @ (wide.T @ t)  # noqa: B023, E731
        shift = theta[: r.shape[1]]
        t = minres(lambda v: away(apply(away(v)) - shift * away(v)), -away(r), inner)  # noqa: B023
        more = orthonormal(t, locked, q)
        if more.shape[1]:
            q, w = np.c_[q, more], np.c_[w, apply(more)]
        else:  # the subspace is whole: only rounding is left
            q = orthonormal(q, locked)
            w = apply(q)
    raise ArithmeticError("residuals haven't reached double precision")


class Whitening:
    """Mean and leading components of the different vectors of a table (x array<long>)."""

    def __init__(self, rows: DataFrame, want: int):
        lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        self.dim, self.n = (lengths[0]["d"] if lengths else 0), 0
        if not lengths:
            return
        blocks = stored(packed(rows.where(F.size("x") == self.dim).select("x").distinct()), "whiten")
        dim, many = self.dim, blocks.rdd.getNumPartitions() > GROUPS
        self.n = int(blocks.agg(F.sum("n")).first()[0])
        self.sums = summed(blocks, lambda x: x.sum(axis=0), (dim,), np.int64, many)
        n, middle = self.n, np.rint(self.sums / self.n).astype(np.int64)
        self.middle, self.fraction = middle, (self.sums - n * middle) / n
        fraction = self.fraction
        off = lambda x: (x - middle).astype(np.float64) - fraction

        def products(b: np.ndarray) -> np.ndarray:
            def one(x: np.ndarray) -> np.ndarray:
                c = off(x)
                return c.T @ (c @ b)

            return summed(blocks, one, b.shape, many=many) / n

        self.trace = float(summed(blocks, lambda x: np.square(off(x)).sum(axis=0), (dim,), many=many).sum() / n)
        values, vectors, self.residual = jacobi_davidson(products, dim, want)
        real = values > FLAT * self.trace
        self.values, self.vectors = values[real], vectors[:, real]
        scaled = self.vectors / np.sqrt(self.values)
        k = scaled.shape[1]

        def covariance(x: np.ndarray) -> np.ndarray:
            z = off(x) @ scaled
            return z.T @ z

        self.identity_error = float(np.abs(summed(blocks, covariance, (k, k), many=many) / n - np.eye(k)).max()) if k else 0.0

    def applied(self, rows: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error of ``rows`` (vec_id, x)."""
        me, names = self, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(me.values)
            scaled = me.vectors / np.sqrt(me.values)
            for batch in batches:
                m = batch.num_rows
                if not m or not k:
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(m, -1)
                d = me.n * x - me.sums
                big = np.square(d.astype(np.float64)).sum(axis=1) >= 2.0**63
                z = ((x - me.middle).astype(np.float64) - me.fraction) @ scaled
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, me.n)), pa.array(np.repeat((d * d).sum(axis=1), k), mask=np.repeat(big, k)), pa.array(z.ravel()), pa.array(np.tile(me.values / me.trace, m)), pa.array(np.full(m * k, me.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        kind = rows.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not self.n:
            return rows.sparkSession.createDataFrame([], schema)
        return rows.where(F.size("x") == self.dim).select("vec_id", "x").mapInArrow(run, schema)


def whiten(embeddings: DataFrame, want: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for
    each row of ``embeddings`` (vec_id, embedding) and component.

    Components c become x = floor(64 * c) + 1000000. Rows whose vector is null or empty, or
    holds null or non-finite entries, take no part; nor do vectors of another length than the
    most frequent one (ties: the longer). Mean and components are those of the different x
    vectors, each once. There are ``want`` components at most, fewer for shorter vectors, and
    none without variance (equal vectors, a single vector or an empty table give no rows). A
    deviation beyond 64 bits is null. Rows that repeat a vec_id, or have none, give rows of
    their own; other columns aren't read.
    """
    small_batches(embeddings.sparkSession)
    rows = embeddings.select("vec_id", lattice().alias("x")).where("x is not null")
    return Whitening(rows, want).applied(rows)
