"""Near duplicates among embeddings of one label: an inverted multi-index over vector halves, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ORACLE, materialize, query, smallest_hashes, table, written
from .components import EDGES, Forest, components
from .topk import usable
from ..functions.text import let

COSINE = 0.98
#: Share of pairs at the threshold whose cell is visited from one of the two; rows the codebooks are fitted
#: on, of each vector length (fewer of long vectors: SAMPLE_BYTES); Lloyd rounds.
RECALL, SAMPLE, SAMPLE_BYTES, ROUNDS = 0.9995, 20_000, 16 << 20, 10
#: Distinct vectors a cell should hold on average, and words of a codebook at most.
CELL_ROWS, MOST_WORDS = 8, 1_024
#: Vectors that live in, and vectors that visit, the cells of one task; visitors compared at a time.
RESIDENTS, VISITORS, CHUNK = 4_096, 8_192, 512
#: First words of labels up to which their table goes to every task.
MAX_BROADCAST = 200_000
VISIT = "size int, code int, own boolean, vector binary"


def squared_distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.square(x).sum(axis=1)[:, None] + np.square(words).sum(axis=1)[None, :] - 2 * x @ words.T


def codebook(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's means of the rows of `x`, from some of its rows."""
    found = x[rng.choice(len(x), min(words, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = squared_distances(x, found).argmin(axis=1)
        count = np.bincount(near, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, near, x)
        found = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], found)
    return found


@dataclass
class Grid:
    """Codebooks of the two halves of unit vectors of one length, and how far a traversal goes.

    A cell is a pair of words. The excess of a cell, seen from a vector, is by how much the squared
    distances of the two halves to its words exceed those to the nearest words. A traversal takes cells
    in the order of their excess, and ends at `reach`.
    """

    first: np.ndarray
    second: np.ndarray
    reach: float = field(default=0.0)

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Excess by each word of the first half and of the second, and the own words."""
        out = []
        for half, words in ((x[:, :self.cut], self.first), (x[:, self.cut:], self.second)):
            far = squared_distances(half, words)
            own = far.argmin(axis=1)
            out.append((far - far[np.arange(len(x)), own][:, None], own))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def fit_grid(sample: np.ndarray, words: int, cosine: float, recall: float, seed: int = 13) -> Grid:
    """A grid for unit vectors like the rows of `sample`.

    For each of them another vector is drawn at the threshold, in a random direction. Reach is the least
    with which `recall` of these pairs meet: one of the two visits the other's cell. Closer pairs meet more often.
    """
    rng, size = np.random.default_rng(seed), sample.shape[1]
    grid = Grid(codebook(sample[:, :size // 2], words, rng), codebook(sample[:, size // 2:], words, rng))
    x = np.vstack([sample] * -(-2_000 // len(sample))) if len(sample) < 2_000 else sample
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * away
    need = []
    for at in range(0, len(x), 4_096):
        a, b = grid.excess(x[at:at + 4_096]), grid.excess(y[at:at + 4_096])
        rows = np.arange(len(a[0]))
        there = a[0][rows, b[2]] + a[1][rows, b[3]]
        back = b[0][rows, a[2]] + b[1][rows, a[3]]
        need.append(np.minimum(there, back))
    grid.reach = float(np.quantile(np.concatenate(need), recall, method="higher")) + 1e-9
    return grid


def unit(vector: Column) -> Column:
    """The vector by its length, in double precision, free of overflow; null for a zero vector."""
    def scaled(v: Column) -> Column:
        most = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        return let(most, lambda m: F.when(m > 0, F.transform(v, lambda x: x / m)))

    def divided(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: x / n))

    return let(let(F.transform(vector, lambda x: x.cast("double")), scaled), divided)


def as_matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, rows, matrix) of a column of lists of doubles, or of their bytes."""
    values = batch.column(column)
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        flat, offsets = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield int(size), rows, flat[offsets[rows][:, None] + np.arange(size)]
    else:
        yield len(values[0].as_py()) // 8, np.arange(len(values)), np.frombuffer(b"".join(values.to_pylist()), np.float64).reshape(len(values), -1)


def visits(batches: Iterator, grids: dict[int, Grid]) -> Iterator:
    """For each vector (id, label, m, unit) a row for each first word that a traversal from it meets."""
    for batch in batches:
        for size, rows, x in as_matrices(batch, "unit"):
            first, _, own, _ = grids[size].excess(x)
            at, code = np.nonzero(first <= grids[size].reach)
            packed = pa.array([v.tobytes() for v in x], pa.binary())
            picked = batch.take(pa.array(rows[at]))
            yield pa.RecordBatch.from_arrays(
                [picked.column(c) for c in ("id", "label", "m")]
                + [pa.array(np.full(len(at), size, np.int32)), pa.array(code.astype(np.int32)), pa.array(code == own[at]), packed.take(pa.array(at))],
                ["id", "label", "m", "size", "code", "own", "vector"])


def joining(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a matrix of links connects, about as many as it has rows and columns."""
    out, open_ = [], linked.any(axis=1)
    if np.count_nonzero(linked) <= 4 * sum(linked.shape):
        x, y = np.nonzero(linked)
        return list(zip(left[x].tolist(), right[y].tolist(), strict=True))
    while open_.any():  # a component at a time, from one of its rows on
        rows = np.zeros(len(left), bool)
        rows[np.argmax(open_)] = True
        root, cols = left[np.argmax(open_)], np.zeros(len(right), bool)
        front = rows
        while front.any():
            new = linked[front].any(axis=0) & ~cols
            cols |= new
            front = linked[:, new].any(axis=1) & ~rows if new.any() else np.zeros(len(left), bool)
            rows |= front
        open_ &= ~rows
        out += [(int(root), int(i)) for i in np.concatenate([left[rows], right[cols]]) if i != root]
    return out


def compare(group: pa.Table, grids: dict[int, Grid], cosine: float) -> pa.Table:
    """Links of the visitors and residents of a task: (a, b, n), where rows with b are edges, others n more links of a.

    A visitor is compared with the residents of each cell of its traversal. It counts the links it
    finds; the resident counts one too unless it finds the link itself, from its own traversal.
    """
    batch = group.combine_chunks().to_batches()[0]
    size, _, x = next(as_matrices(batch, "vector"))
    ids, m = batch.column("id").to_numpy(), batch.column("m").to_numpy()
    lives, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("resident", "visitor"))
    grid, code = grids[size], int(batch.column("code")[0].as_py())
    first, second, own_first, own_second = grid.excess(x)
    count, forest, edges = np.zeros(len(ids), np.int64), Forest(), []
    residents = np.flatnonzero(lives)
    residents = residents[np.argsort(own_second[residents], kind="stable")]
    cells, starts = np.unique(own_second[residents], return_index=True)
    visitors = np.flatnonzero(guest)
    for cell, there in zip(cells, np.split(residents, starts[1:]), strict=True):
        coming = visitors[first[visitors, code] + second[visitors, cell] <= grid.reach]
        for at in range(0, len(coming), CHUNK):
            here = coming[at:at + CHUNK]
            linked = (x[here] @ x[there].T >= cosine) & (ids[here][:, None] != ids[there][None, :])
            if not linked.any():
                continue
            count[here] += linked @ m[there]
            rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            found = linked[np.ix_(rows, cols)]
            here, there_ = here[rows], there[cols]
            finds = first[np.ix_(there_, own_first[here])].T + second[np.ix_(there_, own_second[here])].T <= grid.reach
            count[there_] += m[here] @ (found & ~finds)
            edges += [(a, b) for a, b in joining(found, ids[here], ids[there_]) if forest.join(a, b)]
    some = np.flatnonzero(count)
    return pa.table([pa.array(np.concatenate([ids[some], np.array([a for a, _ in edges], np.int64)]), pa.int64()),
                     pa.array([None] * len(some) + [b for _, b in edges], pa.int64()),
                     pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)]), pa.int64())], ["a", "b", "n"])


def fit_grids(vectors: DataFrame, cosine: float, recall: float, sample: int = SAMPLE) -> dict[int, Grid]:
    """A grid for each vector length, fitted on the rows of smallest hashes: `sample` at most of each length."""
    grids = {}
    for size, count in sorted(vectors.groupBy("size").count().collect()):
        most = max(1, min(sample, SAMPLE_BYTES // (8 * size)))
        rows = smallest_hashes(vectors.filter(F.col("size") == size).select("id", "unit"), "id", most).toArrow()
        x = np.concatenate([c.values.to_numpy() for c in rows["unit"].chunks if len(c)]).reshape(-1, size)
        x = x[np.argsort(rows["id"].to_numpy())]
        words = min(MOST_WORDS, len(x), max(1, round(float(np.sqrt(count / CELL_ROWS)))))
        grids[size] = fit_grid(x, words, cosine, recall)
    return grids


def near_duplicates(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL, key: str = "vec_id",
                    vector: str = "embedding", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `rows`: links join rows of one label and cosine >= `cosine`.

    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable by
    links, kept whether it is the row's own. Rows whose vector is null, empty, zero, or holds a null or
    non-finite component, and rows without label, link with nothing; so do vectors of different lengths.
    Each row is a vector of its own, also where a vec_id is repeated; a component follows rows that share
    a vec_id only through their vectors. A row without vec_id takes no part and has no component. An empty
    table gives no rows; other columns are ignored.

    Equal vectors are folded. Unit vectors live in the cells of a grid, the product of two codebooks,
    and visit cells in the order of distance, as far as `recall` of pairs at the threshold ask for. What
    meets in a cell is decided by the exact cosine; a pair is missed only if neither visits the other's
    cell. Vectors of a first word are dealt to tasks of bounded size, residents times visitors, so a large
    cell takes more tasks; a task hands on counts and a spanning set of links, not pairs.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    given = given.withColumn("unit", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), unit(F.col("vector"))))
    given = materialize(given.drop("vector"), "multi-rows")
    usable_rows = given.filter("unit IS NOT NULL")
    folded = usable_rows.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    folded = written(folded.withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.size("unit")), "multi-folded")
    grids = fit_grids(folded, cosine, recall, sample)
    shared = spark.sparkContext.broadcast(grids)
    schema = f"id bigint, label {folded.schema['label'].dataType.simpleString()}, m bigint, {VISIT}"
    seen = materialize(folded.select("id", "label", "m", "unit").mapInArrow(lambda b: visits(b, shared.value), schema), "multi-visits")
    place = ["label", "size", "code"]
    blocks = seen.groupBy(*place).agg(F.ceil(F.sum(F.col("own").cast("int")) / RESIDENTS).alias("r"), F.ceil(F.count("*") / VISITORS).alias("v"))
    blocks = materialize(blocks.filter("r > 0"), "multi-blocks")
    dealt = seen.join(F.broadcast(blocks) if blocks.count() <= MAX_BROADCAST else blocks, place)
    mine = [F.pmod(F.xxhash64("id", F.lit(turn)), F.col(c)) for turn, c in ((1, "r"), (2, "v"))]
    others = dealt.withColumns({"home": mine[0], "seat": mine[1]})
    # A task is a block of residents and a block of visitors: rows go to all tasks of their row and column.
    as_guest = others.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r") - 1))).withColumn("vb", F.col("seat"))
    as_guest = as_guest.withColumns({"visitor": F.lit(True), "resident": F.col("own") & (F.col("home") == F.col("rb"))})
    as_home = others.filter("own").withColumn("vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("v") - 1))).withColumn("rb", F.col("home"))
    as_home = as_home.filter(F.col("vb") != F.col("seat")).withColumns({"visitor": F.lit(False), "resident": F.lit(True)})
    columns = [*place, "rb", "vb", "id", "m", "vector", "visitor", "resident"]
    # Dealt by all of a task's keys: a plan dealt by `place` would do for the groups, with a large cell in one task.
    tasks = as_guest.select(*columns).unionByName(as_home.select(*columns)).repartition(*place, "rb", "vb")
    found = tasks.groupBy(*place, "rb", "vb").applyInArrow(
        lambda g: compare(g, shared.value, cosine), "a bigint, b bigint, n bigint")
    found = materialize(found, "multi-found")

    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = folded.join(roots, folded["id"] == roots["node"], "left").select("label", "unit", "id", "m", "rep", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "root").join(counts, "id", "left").select(
        "label", "unit", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    alone = given.filter("unit IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable_rows.join(known, ["label", "unit"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query
def op13_multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op13_multi_index_near_dedup"] = """
WITH RECURSIVE usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e
JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY 1) r USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY 1) l USING (vec_id)"""
