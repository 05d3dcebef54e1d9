"""Whitening of embeddings: Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, query, table
from .topk import matrices, usable

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: A singular triplet has converged when its residual is this share of the largest singular value; values
#: under SMALL of the largest are rounding, not variance.
CONVERGED, SMALL, TINY = 1e-13, 1e-9, 1e-12
#: Left vectors are made orthogonal again where an inner product is more than this; convergence is tested each so many steps.
ORTHOGONAL, CHECK_STEPS = 1e-12, 8
#: Components of larger magnitude have no exact whole number here.
MOST = 2.0**46
SUMS = "place bigint, total double"


@dataclass
class Whitening:
    """Components (by falling eigenvalue) of the covariance of `n` distinct vectors with sums `total`."""

    n: int
    total: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * (x - mean) for whole vectors, exactly."""
        return self.n * x - self.total

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint") + SHIFT)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, keep: str = "double") -> np.ndarray:
    """The sum over all rows (x) of what `part` gives for a matrix of them: added up in tasks, then by place."""
    def add(batches: Iterator) -> Iterator:
        total = np.zeros(width, np.int64 if keep == "bigint" else np.float64)
        for _, x in matrices(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "total"])

    got = rows.mapInArrow(add, f"place bigint, total {keep}").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(width, np.int64 if keep == "bigint" else np.float64)
    out[got["place"].to_numpy()] = got["total"].to_numpy()
    return out


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """`v` without its parts along the rows of `basis`, taken away twice."""
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(rows: DataFrame, n: int, total: np.ndarray, want: int, known: np.ndarray, floor: float = 0.0,
                  seed: int = 11) -> tuple[np.ndarray, np.ndarray, bool]:
    """(singular values, right singular vectors, whole) of the centred rows, `want` at most, by falling value.

    Right vectors are sought beside `known`, some right singular vectors found before; only values above
    `floor` need to converge. `whole`: all dimensions have been used, so nothing can be missing.

    Each step makes a pass over the rows: Xv, made orthogonal to all earlier left vectors, and Xᵀ of it.
    A left vector is as long as the table and isn't stored: it is X times a short vector, kept here, and
    each task computes its part of all of them anew. Its inner product with Xv is that of v with Xᵀu,
    known from its own step; the pass measures what is left of them, and where that is more than
    rounding, it is taken away and the pass repeated.
    """
    d, rng = len(total), np.random.default_rng(seed)
    right, short, images, upper = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, 0))

    def fresh() -> np.ndarray:
        v = orthogonal(rng.normal(size=d), np.vstack([known, right]))
        return v / np.linalg.norm(v)

    def back(x, w, short):
        a = (n * x - total) / n
        u = a @ w
        return np.concatenate([a.T @ u, [u @ u], (a @ short.T).T @ u])

    v = fresh()
    while True:
        k = len(right)
        right, column = np.vstack([right, v]), images @ v
        w = v - short.T @ column
        for again in (True, False):
            found = summed(rows, partial(back, w=w, short=short), d + 1 + k)
            alpha, rest = float(np.sqrt(max(found[d], 0.0))), found[d + 1:]
            if not again or np.abs(rest).max(initial=0.0) <= ORTHOGONAL * alpha:
                break
            column, w = column + rest, w - short.T @ rest
        top = max(alpha, float(np.abs(upper).max(initial=0.0)))
        dead = alpha <= TINY * top
        w, g = (np.zeros(d), np.zeros(d)) if dead else (w / alpha, found[:d] / alpha)
        upper = np.pad(upper, ((0, 1), (0, 1)))
        upper[:k, k], upper[k, k] = column, 0.0 if dead else alpha
        short, images = np.vstack([short, w]), np.vstack([images, g])
        size = k + 1
        whole = size + len(known) >= d
        beta, nxt = 0.0, None
        if not whole:
            nxt = orthogonal(g, np.vstack([known, right]))
            beta = float(np.linalg.norm(nxt))
        if whole or beta <= TINY * top or size % CHECK_STEPS == 0:
            p, s, qt = np.linalg.svd(upper)
            sought = max(1, int((s[:want] > floor).sum()))
            done = size >= min(want, d) and (beta * np.abs(p[-1, :sought]) <= CONVERGED * s[0]).all()
            if whole or done:
                return s[:want], qt[:want] @ right, whole
        v = nxt / beta if beta > TINY * top else fresh()


def singular(rows: DataFrame, n: int, total: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest singular values of the centred rows, with right vectors.

    One starting vector meets only one direction of each repeated value. So the search is repeated beside
    what was found, until the rest has no value as large as those.
    """
    values, vectors = np.zeros(0), np.zeros((0, len(total)))
    for turn in itertools.count():
        floor = float(values[want - 1]) if len(values) >= want else 0.0
        more, right, whole = bidiagonalise(rows, n, total, min(want, len(total) - len(values)), vectors, floor, 11 + turn)
        new = more > floor * (1 + CONVERGED)
        values, vectors = np.concatenate([values, more[new]]), np.vstack([vectors, right[new]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
        if whole or not new.any() or len(values) >= len(total) or (more <= 0).any():
            return values[:want], vectors[:want]


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening by the distinct whole vectors (x) of `size` components; None where there are none."""
    counted = summed(distinct, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64), size + 1, "bigint")
    n, total = int(counted[0]), counted[1:]
    if not n:
        return None
    trace = float(summed(distinct, lambda x: np.array([np.square((n * x - total) / n).sum()]), 1)[0]) / n
    values, vectors = singular(distinct, n, total, min(components, size)) if trace > 0 else (np.zeros(0), np.zeros((0, size)))
    real = values > SMALL * values.max(initial=0.0)
    vectors = vectors[real] / np.linalg.norm(vectors[real], axis=1, keepdims=True)
    return Whitening(n, total, vectors, values[real] ** 2 / n, trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    sums = summed(distinct, lambda x: model.project(x).sum(axis=0), k) / model.n

    def products(x):
        z = model.project(x) - sums
        return (z.T @ z).ravel()

    cov = summed(distinct, products, k * k).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of `rows` and component.

    Entries become whole numbers, floor(64 c) + 1,000,000. The covariance, divisor n, is that of the
    distinct vectors; its eigenvectors are numbered from 1 by falling eigenvalue. whitened is the row's
    distance from the mean along the component in deviations, explained the component's share of the
    variance, deviation the exact sum of (n x - S)² over the dimensions (null if it exceeds a long).

    Rows whose vector is null, empty, or holds a null or non-finite entry, or one of 2**46 or more, give
    no rows; so do rows whose vector is not of the most frequent length (of equal ones the longest).
    Directions without variance aren't components: a table of one distinct vector, or an empty one, gives
    no rows. A null or repeated vec_id is a row like others; other columns are ignored.
    """
    spark = rows.sparkSession
    fits = usable(F.col(vector)) & ~F.exists(F.col(vector), lambda x: F.abs(x.cast("double")) >= MOST)
    kept = materialize(rows.filter(fits).select(
        F.col(key).cast("bigint").alias("vec_id"), whole(F.col(vector)).alias("x")), "whitening-rows")
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    kept = kept.filter(F.size("x") == sizes["size"])
    distinct = materialize(kept.select("x").distinct().select(F.lit(0).alias("no"), "x"), "whitening-distinct")
    model = fit(distinct, sizes["size"], components)
    error, shared = identity_error(distinct, model), spark.sparkContext.broadcast(model)
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else np.zeros(0)

    def project(batches: Iterator) -> Iterator:
        m = shared.value
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(m.total))
            far = m.centred(x)
            if float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
                deviation = pa.array(np.square(far).sum(axis=1), pa.int64())
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in far]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            count = batch.num_rows
            at = pa.array(np.repeat(np.arange(count), k))
            flat = {"vec_id": ids.take(at), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * k, m.n)), "deviation": deviation.take(at),
                    "whitened": pa.array(m.project(x).ravel()), "explained": pa.array(np.tile(explained, count)),
                    "identity_error": pa.array(np.full(count * k, error))}
            yield pa.RecordBatch.from_arrays(list(flat.values()), list(flat))

    return kept.mapInArrow(project, schema)


@query
def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
