"""Streaming forms of the window features and of scoring (ST1, ST2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.numeric import ratio
from ..functions.timeparse import window_interval
from ..operators.clean import drop_blank_rows, extract_log_features, normalize_log_level
from ..operators.clean import parse_timestamp
from ..operators.features import _DISTINCTS, _SUMS
from ..operators.forest import Forest, predict


def stream_features(lines: DataFrame, window: str, delay: str) -> DataFrame:
    """Window features of a stream of structured lines, append mode (ST1).

    Of the lines with one LineId in a window, the one of the lowest `pos` counts, whenever it arrives
    before the window closes; lines later than `delay` are dropped. No set of values is ever collected:
    the first stateful step keeps one row per (window, LineId), the second one count per (window, kind,
    value), the third counts those rows per window. All state is spread by key, so one busy window
    does not become one large state row, and it is dropped when its window closes.
    """
    width = window_interval(window)
    rows = (lines.transform(lambda d: drop_blank_rows(d, "pos"))
            .transform(parse_timestamp).transform(normalize_log_level)
            .transform(extract_log_features)
            .filter(F.col("Timestamp").isNotNull())
            .withColumn("event_time", F.col("Timestamp").cast("timestamp"))
            .withWatermark("event_time", delay))
    flags = [flag for _, flag in _SUMS]
    wanted = F.struct(*flags, *[F.col(c).cast("string").alias(name) for name, c in _DISTINCTS])
    first = (rows.groupBy(F.window("event_time", width).alias("w"), "LineId")
             .agg(F.min_by(wanted, "pos").alias("line"))
             .select(F.window_time("w").alias("event_time"), "line.*"))
    # One row per value kind: a line counts once ('line') and offers three values to be distinct.
    kinds = F.explode(F.array(
        F.struct(F.lit("line").alias("kind"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")) for name, _ in _DISTINCTS]))
    long = first.select("event_time", *flags, kinds.alias("k"))
    is_line = F.col("k.kind") == "line"
    per_value = (long.groupBy(F.window("event_time", width).alias("w"), F.col("k.kind").alias("kind"),
                              F.col("k.value").alias("value"))
                 .agg(F.count_if(is_line).alias("logs_per_window"),
                      *[F.sum(F.when(is_line, F.col(flag)).otherwise(F.lit(0))).alias(name)
                        for name, flag in _SUMS]))
    stamped = per_value.withColumn("event_time", F.window_time("w"))
    total = stamped.groupBy(F.window("event_time", width).alias("w")).agg(
        F.sum("logs_per_window").alias("logs_per_window"),
        *[F.sum(name).alias(name) for name, _ in _SUMS],
        *[F.count_if((F.col("kind") == name) & F.col("value").isNotNull()).alias(name)
          for name, _ in _DISTINCTS])
    size = F.col("logs_per_window")
    return total.select(
        F.col("w.start").cast("timestamp_ntz").alias("time_window"),
        *[ratio(F.col(c.replace("_ratio", "_count")), size).alias(c) if c.endswith("_ratio")
          else F.col(c) for c in FEATURES])


def score_batches(model: Forest, sink: Callable[[DataFrame, int], None]) -> Callable:
    """A foreachBatch function that scores feature rows with a fixed forest (ST2)."""
    def run(batch: DataFrame, epoch: int) -> None:
        sink(predict(model, batch), epoch)

    return run


def epoch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each epoch into a folder of its own (ST2).

    An epoch that is run again, after a failure or a restart, replaces what it wrote before, so every
    input row is there once. Read the path as a table; `epoch` is a column of it.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return write
