"""Exact top-k by inner product: distributed selection on histograms of the scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ORACLE, materialize, query, table

K = 5
#: Queries scored in one pass over the vectors; more queries take more passes.
QUERY_BLOCK = 2_048
#: Vectors scored at a time, and bins of one histogram.
CHUNK, BINS = 2_048, 1_024
SCALE = 256
EXACT_FLOAT = 2.0**53
#: Scores lie between -MOST and MOST.
MOST = 2**61


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))


def matrices(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of equal length, at most CHUNK rows each."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for at in range(0, len(rows), CHUNK):
                part = rows[at:at + CHUNK]
                yield ids[part], values[offsets[part][:, None] + np.arange(size)]


class Queries:
    """A block of query vectors by length, and the score range in which each k-th value is sought."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors], np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            self.by_size[int(size)] = rows, np.array([vectors[r] for r in rows], np.int64)

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query rows, scores, own): exact integer inner products; `own` marks a query's own row."""
        rows, block = self.by_size.get(vectors.shape[1], (None, None))
        if rows is None:
            return None
        top = float(np.abs(block).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        if top < EXACT_FLOAT:
            out = (block.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
        else:
            out = block @ vectors.T
        return rows, out, self.ids[rows][:, None] == ids[None, :]


def histograms(batches: Iterator, queries: Queries, low: np.ndarray, high: np.ndarray, width: np.ndarray,
               need: np.ndarray) -> Iterator:
    """Rows (query, bin, count) of a task's scores from `low` to under `high`, in bins of `width`.

    Sought is the need-th highest of all tasks' scores in that range. Bins below the one that holds the
    task's own need-th can't hold it and are left out.
    """
    counts = np.zeros((len(low), BINS), np.int64)
    floor = low.copy()
    for ids, vectors in matrices(batches):
        scored = queries.scores(ids, vectors)
        if scored is None:
            continue
        rows, scores, own = scored
        at, col = np.nonzero((scores >= floor[rows][:, None]) & (scores < high[rows][:, None]) & ~own)
        picked = rows[at]
        bins = (scores[at, col] - low[picked]) // width[picked]
        counts += np.bincount(picked * BINS + bins, minlength=counts.size).reshape(counts.shape)
        above = counts[:, ::-1].cumsum(axis=1)  # entries from the top down to each bin
        full = above[:, -1] >= need
        best = BINS - 1 - np.argmax(above >= need[:, None], axis=1)
        floor = np.where(full, low + best * width, floor)
    keep = (np.arange(BINS)[None, :] >= ((floor - low) // width)[:, None]) & (counts > 0)
    q, b = np.nonzero(keep)
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(counts[q, b], pa.int64())], ["q", "bin", "n"])


def winners(batches: Iterator, queries: Queries, kth: np.ndarray, k: int) -> Iterator:
    """Rows (query, vec_id, score) at or above each k-th value; of one task's ties the k smallest ids."""
    held: dict[int, list[tuple[int, int]]] = {}
    for ids, vectors in matrices(batches):
        scored = queries.scores(ids, vectors)
        if scored is None:
            continue
        rows, scores, own = scored
        at, col = np.nonzero((scores >= kth[rows][:, None]) & ~own)
        order = np.lexsort((ids[col], -scores[at, col], at))
        at, col = at[order], col[order]
        first = np.searchsorted(at, at, side="left")
        best = np.arange(len(at)) - first < k
        for a, c in zip(at[best], col[best], strict=True):
            held.setdefault(int(rows[a]), []).append((-int(scores[a, c]), int(ids[c])))
        for q in {int(rows[a]) for a in np.unique(at)}:
            held[q] = sorted(held[q])[:k]
    flat = [(q, i, -s) for q, best in held.items() for s, i in best]
    cols = list(zip(*flat, strict=True)) if flat else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "vec_id", "score"])


def kth_values(vectors: DataFrame, shared, queries: Queries, bound: int, k: int) -> np.ndarray:
    """Each query's k-th highest score; below every score where there are fewer than k candidates."""
    n = len(queries.ids)
    low, high = np.full(n, -bound, np.int64), np.full(n, bound + 1, np.int64)
    need, open_ = np.full(n, k, np.int64), np.ones(n, bool)
    while open_.any():
        width = np.maximum(1, -(-(high - low) // BINS))

        def count(batches, low=low.copy(), high=high.copy(), width=width, need=need.copy()):
            yield from histograms(batches, shared.value, low, high, width, need)

        totals = vectors.mapInArrow(count, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        got = totals.toArrow()
        q, b, c = (got.column(x).to_numpy() for x in ("q", "bin", "n"))
        order = np.lexsort((-b, q))
        q, b, c = q[order], b[order], c[order]
        upto = c.cumsum()
        starts = np.searchsorted(q, q, side="left")
        upto -= (upto - c)[starts]
        here = (upto >= need[q]) & (upto - c < need[q])
        lacking = open_.copy()
        lacking[q[here]] = False
        low[lacking], high[lacking], open_[lacking] = -bound, -bound, False  # all candidates are wanted
        q, b, above = q[here], b[here], (upto - c)[here]
        low[q] += b * width[q]
        need[q] -= above  # what lies above the bin is settled
        high[q] = np.minimum(high[q], low[q] + width[q])
        found = q[width[q] == 1]
        open_[found], high[found] = False, low[found]
    return low


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = QUERY_BLOCK,
          key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k other rows of highest integer inner product for each query.

    Rows without id, and vectors that are null, empty or hold a null or non-finite component, take no
    part. A query meets candidates of its own length only. Fewer candidates than k give all of them;
    ties go to the smaller id; repeated candidate rows are candidates each, a repeated query id is
    asked once, with its least vector. Scores beyond 61 bits aren't told apart. An empty table gives no rows; other columns are ignored.
    Work is queries x rows, in blocks of `block` queries that are sent to where the rows are; what
    leaves a task is a few counts, and then at most k rows, per query.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector)).alias("v"), is_query.alias("asked"))
    rows = materialize(rows, "topk-vectors")
    asked = rows.filter("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = rows.select("vec_id", "v")
    stats = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"),
                     F.sum(F.col("asked").cast("bigint")).alias("n")).first()
    passes = -(-(stats.n or 0) // block)
    bound = min(MOST, int((stats.norm or 0) * (1 + 1e-9)) + 1)  # |inner product| <= largest squared norm
    found = []
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").collect()
        if not part:
            continue
        queries = Queries([r.vec_id for r in part], [r.v for r in part])
        shared = spark.sparkContext.broadcast(queries)
        kth = kth_values(candidates, shared, queries, bound, k)
        ids = spark.createDataFrame([(i, int(v)) for i, v in enumerate(queries.ids)], "q bigint, query_id bigint")

        def pick(batches, shared=shared, kth=kth):
            yield from winners(batches, shared.value, kth, k)

        best = candidates.mapInArrow(pick, "q bigint, vec_id bigint, score bigint").groupBy("q").agg(
            F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
        ranked = best.join(ids, "q").select("query_id", F.posexplode("best").alias("at", "b"))
        found.append(materialize(ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"),
                                               F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")), "topk-best"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query
def op3_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op3_histogram_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
