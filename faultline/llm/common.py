"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.materialize import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Name of the module that holds what a worker keeps.
WORKER = "_faultline_worker"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def named_key(kind: T.DataType, rest: str) -> T.StructType:
    """Columns `key`, of any type, and `rest`; a type's text can't be parsed where it holds odd names."""
    return T.StructType([T.StructField("key", kind), *T.StructType.fromDDL(rest).fields])


def mapped(docs: DataFrame, task: Callable[[Iterator], Iterator]) -> DataFrame:
    """`docs` through a task on Arrow batches that keeps the columns, whatever names these have."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidied(task), plain.schema).toDF(*docs.columns)


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """Record batches of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Returns freed memory of this worker to the system: a worker is kept, and shares its machine with what runs next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(owner: str, make: Callable[[], object]) -> object:
    """What this worker process keeps from task to task, of one owner at a time.

    It is held in a module made for it, because the functions of a job come anew with each task.
    """
    held = sys.modules.setdefault(WORKER, types.ModuleType(WORKER)).__dict__.setdefault("kept", {})
    if owner not in held:
        held.clear()
        held[owner] = make()
    return held[owner]


def tidied(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`task` on the batches of a partition; what another one has kept goes before, freed memory is given back after."""
    def run(batches: Iterator) -> Iterator:
        sys.modules.get(WORKER, types.ModuleType(WORKER)).__dict__.get("kept", {}).clear()
        yield from task(batches)
        give_back()

    return run


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run within send `rows` rows at a time to Python at most; the session's setting returns after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """materialize() for rows that carry numbers given by the run: read again, these would be others."""
    found = materialize(df, label)
    if found is df:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    return found


def most_frequent(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Rows with the largest values of `by` (1 or more), `most` at most; of about equal values all or none.

    A histogram of the logarithm, of some thousand cells at any size, gives the least value kept.
    """
    cell = F.floor(F.log2(F.col(by)) * 64).cast("int")
    cells = sorted(((r.cell, r["count"]) for r in rows.groupBy(cell.alias("cell")).count().collect()), reverse=True)
    least, kept = None, 0
    for value, count in cells:
        kept += count
        if kept > most:
            break
        least = value
    return rows.filter(F.lit(False)) if least is None else rows.filter(cell >= least)


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows of smallest hash of `key`; rows that can hardly be among them are left out first."""
    share = min(1.0, 2 * (most + 100) / max(1, rows.count()))
    likely = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))
    return likely.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 20)), key).limit(most)


__all__ = ["batch_rows", "give_back", "kept", "mapped", "named_key", "quoted", "tidied", "most_frequent", "smallest_hashes", "QUERIES", "ORACLE", "Query", "query", "table", "slices", "materialize", "written"]
