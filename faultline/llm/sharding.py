"""Minimax contiguous sharding of atomic groups of equal texts, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, query, table

KEY_BITS = 60
#: Bits of the group key by which the first histogram, and then each refinement, splits cells.
FIRST_BITS, STEP_BITS = 12, 8
#: Rows numbered by one window at most, on average.
SLOT_ROWS = 20_000


def order_key(col: Column) -> Column:
    """First 60 bits of the md5 of a text; null keeps its own key. Equal texts have equal keys."""
    return F.conv(F.substring(F.md5(F.coalesce(col, F.lit("\x00null"))), 1, KEY_BITS // 4), 16, 10).cast("bigint")


class Cells:
    """Key-ordered histogram of groups: (first key, bits, bytes, groups, largest group) per cell."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.bounds = [0, *accumulate(r[2] for r in self.rows)]
        self.largest = max((r[4] for r in self.rows), default=0)

    def ends(self, capacity: int, shards: int, whole: bool, known: bool = True) -> list[int]:
        """Positions in the ordered bytes at which greedy filling ends each shard.

        `whole`: a cell is never cut, so the cuts among single groups lie at these or beyond; else a
        cell of several groups can be cut anywhere, and they lie at these or before. Without `known`,
        a shard ends at most one largest group short of the capacity, also inside a cell.
        """
        found, pos = [], 0
        for _ in range(shards):
            at = bisect_right(self.bounds, pos + capacity) - 1
            inside = at < len(self.rows) and not whole and self.rows[at][3] > 1
            pos = max(pos, pos + capacity if inside else self.bounds[at], 0 if known else pos + capacity - self.largest)
            found.append(min(pos, self.bounds[-1]))
        return found

    def capacity(self, shards: int, whole: bool) -> int:
        """Smallest capacity with which greedy filling places everything, by binary search."""
        total = self.bounds[-1]
        lo, hi = max(self.largest, -(-total // shards), 1), max(total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.ends(mid, shards, whole)[-1] < total:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def open_cells(self, shards: int) -> list[tuple[int, int, int, int, int]]:
        """Cells of several groups within which a cut of the best partition may lie."""
        low = self.ends(self.capacity(shards, False), shards, True, known=False)
        high = self.ends(self.capacity(shards, True), shards, False)
        spans = list(zip(low[:-1], high[:-1], strict=True))
        found, at = [], 0
        for cell, pos, end in zip(self.rows, self.bounds, self.bounds[1:], strict=False):
            while at < len(spans) and spans[at][1] < pos:
                at += 1
            if cell[3] > 1 and any(a < end and b > pos for a, b in spans[at:]):
                found.append(cell)
        return found

    def cuts(self, shards: int) -> list[int]:
        """First keys of shards 1, 2, ... under the smallest feasible capacity."""
        places = dict(zip(self.bounds, [r[0] for r in self.rows], strict=False))
        ends = self.ends(self.capacity(shards, True), shards, True)
        return [places[e] for e in ends[:-1] if e in places and e < self.bounds[-1]]


def _histogram(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    cell = F.shiftright("group_key", KEY_BITS - bits)
    rows = groups.groupBy(cell.alias("cell")).agg(
        F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()
    return [(r.cell << (KEY_BITS - bits), bits, r.b, r.n, r.m) for r in rows]


def _inside(cells, col: str) -> Column:
    """Whether the key is in one of the cells."""
    test = F.lit(False)
    for bits in {c[1] for c in cells}:
        test = test | F.shiftright(col, KEY_BITS - bits).isin([c[0] >> (KEY_BITS - bits) for c in cells if c[1] == bits])
    return test


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(keys of groups that fill a shard alone, first keys of the later of the other shards).

    `groups` has group_key and bytes. A group above the mean of what is left to the shards that are
    left gets a shard of its own. Over the others, in key order, the smallest feasible capacity is
    found by binary search with a greedy check. The search runs on a histogram of key ranges; only
    ranges in which a cut may lie are split further, until these hold one group each, so the cuts are
    those of the full list while the driver holds some thousands of numbers at any size.
    """
    top = groups.orderBy(F.desc("bytes"), "group_key").limit(shards).collect()
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    for r in top:
        free = shards - len(alone)
        if free < 2 or r.bytes * free <= left:
            break
        alone.append(r.group_key)
        left -= r.bytes
    rest = groups.filter(~F.col("group_key").isin(alone)) if alone else groups
    free = shards - len(alone)
    cells = Cells(_histogram(rest, FIRST_BITS))
    while wanted := cells.open_cells(free):
        bits = min(KEY_BITS, wanted[0][1] + STEP_BITS)
        wanted = {c for c in wanted if c[1] < bits}
        finer = _histogram(rest.filter(_inside(wanted, "group_key")), bits)
        cells = Cells([c for c in cells.rows if c not in wanted] + finer)
    return alone, cells.cuts(free)


def number_slots(rows: DataFrame, shard: str, key: Column, ties: list[str], total: int) -> DataFrame:
    """Adds `slot`: the place of a row in its shard by `key` (60 bits), from 0, without gaps.

    Rows are numbered within key ranges of about SLOT_ROWS rows; the ranges' counts give each its
    offset. No task sees a whole shard.
    """
    bits = max(0, (max(total, 1) // SLOT_ROWS).bit_length())
    keyed = rows.withColumn("_key", key).withColumn("_part", F.shiftright("_key", KEY_BITS - bits) if bits else F.lit(0))
    counts = keyed.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(shard, "_part").orderBy("_key", *ties)
    return (keyed.withColumn("_row", F.row_number().over(here)).join(offsets, [shard, "_part"])
            .withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("bigint"))
            .drop("_key", "_part", "_n", "_row", "_before"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs` (doc_id, text).

    Size is the UTF-8 bytes of the text (null: none) plus 1. Rows of equal text, also all rows
    without text, are one group and stay in one shard; shard sizes are as equal as whole groups
    allow. Fewer groups than shards leave shards empty; an empty table gives no rows; repeated rows
    and null ids are rows like others; other columns are ignored.
    """
    text = F.col("text")
    narrow = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        order_key(text).alias("group_key")), "shard-rows")
    groups = materialize(narrow.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    alone, cuts = plan_cuts(groups, shards)
    shard = F.lit(len(alone))
    for key in cuts:
        shard = shard + F.when(F.col("group_key") >= key, 1).otherwise(0)
    for i, key in enumerate(alone):
        shard = F.when(F.col("group_key") == key, i).otherwise(shard)
    placed = narrow.withColumn("shard", shard.cast("int"))
    # The text is part of the key, so that rows without doc_id, or of a repeated one, spread over the ranges too.
    place = order_key(F.concat_ws("|", F.col("doc_id").cast("string"), "group_key", "text_crc32", "size"))
    slots = number_slots(placed, "shard", place, ["doc_id", "size", "text_crc32", "group_key"], total)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
