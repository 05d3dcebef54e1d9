"""Global order without a global sort in one task: running totals, dense numbers, quantiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialize import materialize

#: Rows of one key range, on average.
RANGE_ROWS = 100_000
#: Cells that a range of values is counted in at a time.
BINS = 256
SKETCH_ACCURACY = 10_000


def _in_ranges(df: DataFrame, key: str, range_rows: int) -> DataFrame:
    """Rows with `_bucket`, the number of their key range; as many ranges as the row count asks for.

    The placed rows are written once, so every later step and every retry sees the same ranges.
    """
    ranges = -(-df.count() // range_rows)
    if ranges <= 1:
        return df.withColumn("_bucket", F.lit(0))
    return materialize(df.repartitionByRange(ranges, key).withColumn("_bucket", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, key: str, sums: dict[str, str], descending: bool = False,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """Inclusive running sums of columns in the order of `key`, which must be unique and non-null.

    Rows are placed by key range; ranges are summed (a row per `range_rows` rows), and each range is
    windowed on its own with the total of the ranges before it added. `df` is read more than once;
    pass a written table when it is costly.
    """
    df = _in_ranges(df, key, range_rows)

    def direction(col: str) -> Column:
        return F.desc(col) if descending else F.asc(col)

    totals = df.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = (Window.partitionBy("_bucket").orderBy(direction(key))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.join(offsets, "_bucket")
            .withColumns({out: F.col(f"_o_{c}") + F.sum(c).over(inside) for c, out in sums.items()})
            .drop("_bucket", *[f"_o_{c}" for c in sums]))


def number_by_day(df: DataFrame, ts: str, out: str) -> DataFrame:
    """Dense chronological numbers 1.. over unique timestamps.

    Days are counted, the counts are prefix-summed (one row per calendar day: some ten thousand rows
    for thirty years), and rows are numbered inside their day.
    """
    df = df.withColumn("_day", F.to_date(ts))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (df.groupBy("_day").agg(F.count(F.lit(1)).alias("_c"))
            .select("_day", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy("_day").orderBy(ts)
    return (df.join(days, "_day")
            .withColumn(out, (F.col("_o") + F.row_number().over(inside)).cast("long"))
            .drop("_day", "_o"))


def number_rows(df: DataFrame, order: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Dense numbers 0.. over all rows in the order of `order`, which must identify a row.

    Ranges are cut over the whole key, so one document or source with a large share of all rows is
    spread over many ranges. `df` is read more than once; pass a written table when it is costly.
    """
    keyed = _in_ranges(df.withColumn("_key", F.struct(*order)), "_key", range_rows)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_key")
    return (keyed.join(starts, "_bucket")
            .withColumn(out, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
            .drop("_start", "_bucket", "_key"))


@dataclass
class _Rank:
    """The value sought: `left` values from `low` on are smaller, and it isn't above `high`."""

    name: str
    left: int
    low: float
    high: float
    found: bool = False


def _closed_in(values: DataFrame, wanted: list[_Rank]) -> None:
    """One round: each open rank's range of values becomes that of the bin that holds the rank."""
    spans = values.sparkSession.createDataFrame(
        [(r.name, i, r.low, r.high) for i, r in enumerate(wanted)], "_name string, _i int, _lo double, _hi double")
    # Halves, because a range of doubles may be wider than the largest double.
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    cell = F.least(F.floor(place * BINS), F.lit(BINS - 1)).cast("int")
    rows = (values.join(F.broadcast(spans), "_name").filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
            .groupBy("_i", cell.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    for r in sorted(rows.collect()):
        rank = wanted[r["_i"]]
        if rank.found:
            continue
        if rank.left < r["n"]:
            rank.low, rank.high, rank.found = r["lo"], r["hi"], True
        else:
            rank.left -= r["n"]


def _narrowed(values: DataFrame, open_: dict, near: dict[tuple[str, int], tuple[float, float]]) -> None:
    """Ranks whose sketched range is proven to hold them go on with that range."""
    asked = [key for key in open_ if key in near and near[key][0] <= near[key][1]]
    if not asked:
        return
    spans = values.sparkSession.createDataFrame(
        [(key[0], i, *near[key]) for i, key in enumerate(asked)], "_name string, _i int, _lo double, _hi double")
    counts = values.join(F.broadcast(spans), "_name").groupBy("_i").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("under"), F.count_if(F.col("_v") <= F.col("_hi")).alias("upto")).collect()
    for r in counts:
        rank = open_[asked[r["_i"]]]
        if r["under"] <= rank.left < r["upto"]:
            rank.low, rank.high = near[asked[r["_i"]]]
            rank.left -= r["under"]


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> list[list[float | None]]:
    """For each share the exact, linearly interpolated quantiles of the columns.

    NULL and NaN are skipped, no value gives None. A sketch gives each rank a range of values, if counts
    prove that it holds the rank. Then each round counts the values within the ranges that are left, in
    BINS equal cells with their least and largest value, and keeps the cell that holds the rank; a cell of
    one value ends it. Nothing is ordered, and what the driver sees is a few numbers per rank and cell.
    `df` is read once a round; pass a written table when it is costly.
    """
    values = (df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_name", "_v")
              .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    finite = F.abs("_v") < float("inf")
    margin = 3.0 / SKETCH_ACCURACY
    sketched = [x for share in shares for x in (max(0.0, share - margin), min(1.0, share + margin))]
    figures = {r["_name"]: r for r in values.groupBy("_name").agg(
        F.count_if(finite).alias("n"), F.count_if(F.col("_v") == float("-inf")).alias("below"), F.count(F.lit(1)).alias("all"),
        F.min(F.when(finite, F.col("_v"))).alias("lo"), F.max(F.when(finite, F.col("_v"))).alias("hi"),
        F.percentile_approx(F.when(finite, F.col("_v")), sketched, SKETCH_ACCURACY).alias("near")).collect()}
    ranks: dict[tuple[str, int], _Rank] = {}

    def seek(name: str, rank: int) -> None:
        r = figures[name]
        inside = rank - r["below"]
        if inside < 0 or inside >= r["n"]:
            end = float("-inf") if inside < 0 else float("inf")
            ranks.setdefault((name, rank), _Rank(name, 0, end, end))
        else:
            ranks.setdefault((name, rank), _Rank(name, inside, r["lo"], r["hi"]))

    near: dict[tuple[str, int], tuple[float, float]] = {}
    for name, r in figures.items():
        for i, share in enumerate(shares):
            k = math.floor((r["all"] - 1) * share)
            for rank in (k, min(r["all"] - 1, k + 1)):
                seek(name, rank)
                if r["near"]:
                    near[name, rank] = r["near"][2 * i], r["near"][2 * i + 1]
    _narrowed(values.filter(finite), {key: r for key, r in ranks.items() if r.low < r.high}, near)
    while open_ := [r for r in ranks.values() if r.low < r.high]:
        for r in open_:
            r.found = False
        _closed_in(values.filter(finite), open_)

    def at(name: str, share: float) -> float | None:
        if name not in figures:
            return None
        place = (figures[name]["all"] - 1) * share
        k = math.floor(place)
        low, high = ranks[name, k].low, ranks[name, min(figures[name]["all"] - 1, k + 1)].low
        return low if low == high else low + (high - low) * (place - k)

    return [[at(c, share) for c in columns] for share in shares]


def exact_quantile(df: DataFrame, columns: list[str], q: float) -> DataFrame:
    """One row of exact, linearly interpolated quantiles; NULLs are skipped, no value gives NULL."""
    found = exact_quantiles(df, columns, [float(q)])
    return df.sparkSession.createDataFrame([tuple(found[0])], ", ".join(f"`{c}` double" for c in columns))
