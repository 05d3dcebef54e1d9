"""Groups of one table meet all groups of another, each packed into one row, without a copy for each meeting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks for each core, so that uneven ones even out.
TASKS = 4


def held_list(values: pa.Array) -> pa.Array:
    """All values as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def lane_count(cores: int, parts: int) -> int:
    """So many lanes that lanes and parts give every core its tasks; with many parts there are few lanes."""
    return max(1, -(-TASKS * cores // parts))


def meet(here: DataFrame, key: str, lanes: int, come: DataFrame, part: str, parts: int,
         task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `task` makes of the rows of `here`, dealt into lanes by `key`, each beside the rows of `come`, one of each `part`.

    Both sides are shuffled once, `come` by ranges: no task gets two parts while another has none. A task reads
    a lane and a part: it holds the part and sees the lane's rows one after the other, so it can carry on what
    it found, and rows leave it as often as there are lanes at most.
    """
    return here.repartition(lanes, key).hint("shuffle_replicate_nl").crossJoin(come.repartitionByRange(parts, part)).mapInArrow(task, schema)
