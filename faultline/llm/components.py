"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGES = "a bigint, b bigint"
#: Nodes that a task holds at a time while it contracts edges.
LOCAL_EDGES = 500_000


class Forest:
    """Disjoint sets with the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.up.setdefault(top, top)) != top:
            top = above
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether `a` and `b` were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def contract(batches: Iterator, most: int) -> Iterator:
    """Edges of a task as stars around the smallest node of what they connect; nodes beyond `most` start anew."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > most:
            yield stars()
            forest.up.clear()
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of large-star or small-star: neighbours move to the smallest node next to their own."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.filter("u <> m").select("u", "m"))


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """node, root for every node of `edges` (a, b: integers): root is the smallest node reachable.

    Edges are contracted within tasks, some `local` nodes at a time. Half as many edges have no more nodes
    and are done in one task then; more go through alternating large and small stars until nothing
    changes. Nothing of a component meets in one task but `local` edges and the minimum of a node's
    neighbours.
    """
    def contracted(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: contract(batches, local), EDGES)

    now = materialize(contracted(edges.filter("a <> b")), "cc-edges")
    seen = None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if 2 * count <= local:
            now = materialize(contracted(now.coalesce(1)), "cc-edges")
            break
        if (count, total) == seen:  # the same edges again: each node points at its root
            break
        seen = count, total
        stars = _star(_star(now, True).distinct(), False).distinct()
        now = materialize(contracted(stars.coalesce(-(-count // local))).distinct(), "cc-edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
