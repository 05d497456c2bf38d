"""Whitening of embeddings by their leading principal components, found by LOBPCG.

The covariance matrix is never formed. Each step makes one distributed product of it with a block of directions over the
centred rows (a few kilobytes from each task, added up in two levels), and the driver does Rayleigh-Ritz in the space
of the iterate, the new residual directions and the previous ones, at most three blocks wide. All three are kept
orthonormal, and their products are carried along by orthonormal combinations, so rounding doesn't grow. The end
is certified: the iterate's product is made anew from the rows, and the residuals of that must be small.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded

_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def grid_vectors(embeddings: DataFrame, steps: int = 256) -> DataFrame:
    """vec_id and x, the vector on a grid of 1/steps as whole numbers: floor(steps * c) of each entry c.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are vectors that aren't of the
    commonest length (of equally common ones the shortest). Equal vectors, repeated rows and null ids stay.
    """
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("size(embedding) > 0").where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    v = v.select("vec_id", F.transform("embedding", lambda c: F.floor(c * steps).cast("long")).alias("x"))
    length = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return v.join(F.broadcast(length), F.size("x") == F.col("d")).select("vec_id", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _total(rows: DataFrame, term, kind: str, most: int = 256) -> np.ndarray | None:
    """The sum over all rows of term(x), an array of fixed size, x being a block of vectors; None without rows."""
    schema = pa.schema([("part", pa.int32()), ("sums", pa.list_(pa.int64() if kind == "long" else pa.float64()))])

    def row(part, sums):
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([sums], schema.field(1).type)], schema=schema)

    def first(batches):
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                new = term(_matrix(batch["x"].slice(a, 4096))).ravel()
                total = new if total is None else total + new
        if total is not None:
            yield row(TaskContext.get().partitionId(), total)

    def second(batches):
        total = None
        for batch in batches:
            for sums in batch["sums"]:
                new = sums.values.to_numpy(zero_copy_only=False)
                total = new if total is None else total + new
        if total is not None:
            yield row(0, total)

    ddl = f"part int, sums array<{kind}>"
    sums = bounded(rows.select("x")).mapInArrow(first, ddl)
    if sums.rdd.getNumPartitions() > most:
        sums = sums.repartition(most, "part").mapInArrow(second, ddl)
    found = [np.array(r["sums"]) for r in sums.collect()]  # at most `most`
    return sum(found[1:], found[0]) if found else None


def _fresh(directions: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the directions add to an orthonormal basis."""
    w = directions
    for _ in range(3):
        norms = np.linalg.norm(w, axis=0)
        w = w[:, norms > 0] / norms[norms > 0]
        w = w - basis @ (basis.T @ w)
        if not w.size:
            return w
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, s > 1e-6][:, : len(w) - basis.shape[1]]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


@dataclass
class Components:
    vectors: np.ndarray  # a column each, falling variance
    values: np.ndarray
    residual: float  # the largest, relative to the largest value
    rounds: int


def leading_components(product, d: int, k: int, block: int, tolerance: float, loose: float, rounds: int) -> Components:
    """The k leading unit eigenvectors of a symmetric d x d matrix that is only known by product(block of columns).

    Ends when the residuals, from products made anew, are within `tolerance` of the largest eigenvalue, or no longer fall
    and are within `loose`; raises an error after `rounds` steps.
    """
    m = min(d, max(block, k))
    x = np.linalg.qr(np.random.default_rng(20).standard_normal((d, m)))[0]
    vx = product(x)
    p, vp = x[:, :0], vx[:, :0]
    least, stale = np.inf, 0
    for step in range(1, rounds + 1):
        h = x.T @ vx
        values, c = np.linalg.eigh((h + h.T) / 2)
        values, c = values[::-1], c[:, ::-1]
        x, vx = x @ c, vx @ c
        r = vx - x * values
        size = np.linalg.norm(r[:, :k], axis=0).max() / max(values[0], np.finfo(float).tiny)
        least, stale = (size, 0) if size < least / 2 else (least, stale + 1)
        if size <= tolerance or (size <= loose and stale >= 2):
            if step > 1 and certified:
                return Components(x[:, :k], values[:k], float(size), step)
            x = np.linalg.qr(x)[0]
            vx, p, vp, certified = product(x), x[:, :0], vx[:, :0], True
            continue
        certified = False
        w = _fresh(r, np.hstack([x, p]))
        q, vq = np.hstack([x, p, w]), np.hstack([vx, vp, product(w) if w.shape[1] else w])
        h = q.T @ vq
        c = np.linalg.eigh((h + h.T) / 2)[1][:, ::-1][:, :m]
        moved = c.copy()
        moved[:m] = 0  # the step without what it keeps of the old iterate
        moved = _fresh(moved, c)
        x, vx, p, vp = q @ c, vq @ c, q @ moved, vq @ moved
    raise RuntimeError(f"the residual is {least:.1e} after {rounds} steps")


def whiten(embeddings: DataFrame, k: int = 4, steps: int = 256, block: int = 24, tolerance: float = 1e-14, loose: float = 1e-11, rounds: int = 500) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and leading component.

    Vectors are those of grid_vectors, on its grid. Components are fitted on each distinct vector x once, n of them with
    sums S. whitened: x - S/n on the component, over the root of its variance. deviation: the sum over dimensions of
    (n*x - S)^2, exact, as decimal(38). explained: the component's share of the variance. identity_error: the largest
    absolute entry of whitened's covariance over the fit list less the identity. A component's largest entry is positive.

    Components of no variance are left out, so one distinct vector, like an empty table, gives no rows; shorter
    vectors have fewer components. Equally large variances have any orthonormal basis of their space, the same for all rows.
    Repeated rows have rows each, null ids too; other columns are ignored. Entries beyond 2^40 on the grid are an error. block:
    how many directions are iterated at once; products cost a pass over the distinct vectors.
    """
    rows = grid_vectors(embeddings, steps)
    fit = Written(rows.select("x").distinct(), "fit").read()
    top = fit.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"),
        F.max(F.array_max(F.transform("x", F.abs))).alias("high"),
    ).first()
    n, d = top["n"], top["d"]
    empty = fit.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not n:
        return empty
    if not 0 <= top["high"] <= 1 << 40:
        raise ValueError(f"an entry is {top['high']} steps of the grid from zero; {1 << 40} are allowed")
    square = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")) if top["high"] > 1 << 26 else F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    squares = int(fit.agg(F.sum(square.cast("decimal(38,0)"))).first()[0])
    sums = [int(s) for s in _total(fit, lambda x: x.sum(axis=0), "long")]
    trace = (n * squares - sum(s * s for s in sums)) / n**2
    if trace <= 0:
        return empty
    mean = np.array([s / n for s in sums])

    def product(b: np.ndarray) -> np.ndarray:
        def term(x):
            x = x - mean
            return x.T @ (x @ b)

        return _total(fit, term, "double").reshape(d, b.shape[1]) / n

    found = leading_components(product, d, min(k, d), block, tolerance, loose, rounds)
    alive = found.values > 1e-12 * trace
    vectors, values = found.vectors[:, alive], found.values[alive]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled, count = vectors / np.sqrt(values), len(values)

    def outer(x):
        z = (x - mean) @ scaled
        return z.T @ z

    error = float(np.abs(_total(fit, outer, "double").reshape(count, count) / n - np.eye(count)).max())
    explained = values / trace
    exact = (n * top["high"] + max(map(abs, sums))) ** 2 * d >= 1 << 63
    own = np.array(sums, object if exact else np.int64)

    def rows_of(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                x, ids = _matrix(batch["x"].slice(a, 4096)), batch["vec_id"].slice(a, 4096)
                far = ((n * x.astype(own.dtype) - own) ** 2).sum(axis=1)
                far = pa.array([Decimal(int(v)) for v in far], pa.decimal128(38, 0)) if exact else pa.array(far).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(len(x)), count))
                columns = [
                    ids.take(at), np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), np.full(len(at), n), far.take(at),
                    ((x - mean) @ scaled).ravel(), np.tile(explained, len(x)), np.full(len(at), error),
                ]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return bounded(rows).mapInArrow(rows_of, empty.schema)
