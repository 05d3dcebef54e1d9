"""Window features (A1..A3) and statistics over them (A7..A9, N11, N12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES, SIGNALS
from ..functions.numeric import coerce, ratio
from ..functions.ordering import exact_quantile
from .clean import preprocess_logs, require

_SUMS = [
    ("error_count", "is_error"), ("warning_count", "is_warning"),
    ("info_count", "is_info"), ("fatal_count", "is_fatal"),
] + [(feature, row_flag) for _, _, row_flag, feature in SIGNALS]
_DISTINCTS = [
    ("unique_components", "Component"), ("unique_event_ids", "EventId"), ("unique_processes", "Pid"),
]


def create_features(lines: DataFrame) -> DataFrame:
    """One row per window: counts, distinct counts and ratios (A1, A2).

    Lines are first reduced to (window, component, event, process), combined map-side. The three
    distinct counts expand only those reduced rows, and a window holding a large share of all lines
    is spread over its processes before its few partial rows meet in one task.
    """
    require(lines, ["time_window", "Component", "EventId", "Pid"] + [f for _, f in _SUMS])
    reduced = lines.groupBy("time_window", *[c for _, c in _DISTINCTS]).agg(
        F.count(F.lit(1)).alias("logs_per_window"),
        *[F.sum(flag).alias(name) for name, flag in _SUMS])
    features = reduced.groupBy("time_window").agg(
        F.sum("logs_per_window").alias("logs_per_window"),
        *[F.sum(name).alias(name) for name, _ in _SUMS],
        *[F.countDistinct(c).alias(name) for name, c in _DISTINCTS])
    size = F.col("logs_per_window")
    features = features.withColumns({
        f"{name}_ratio": ratio(F.col(f"{name}_count"), size) for name in ("error", "warning", "fatal")
    })
    return features.select("time_window", *FEATURES)


def preprocess(df: DataFrame, window: str, pos: str = "pos") -> DataFrame:
    """Raw lines to window features (A3)."""
    return create_features(preprocess_logs(df, window, pos))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values of a column, nulls left out; ties by value."""
    return (df.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(n))


def coerce_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Feature columns as finite doubles or NULL; other columns stay."""
    columns = columns or FEATURES
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return df.withColumns({c: coerce(c) for c in columns})


def feature_medians(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of medians; a column without any value gives 0."""
    columns = columns or FEATURES
    row = exact_quantile(coerce_features(df, columns), columns, 0.5)
    return row.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing feature values replaced by the column median."""
    columns = columns or FEATURES
    medians = feature_medians(df, columns).select(F.struct(*columns).alias("m")).scalar()
    return (coerce_features(df, columns).withColumn("_m", medians)
            .withColumns({c: F.coalesce(F.col(c), F.col("_m").getField(c)) for c in columns})
            .drop("_m"))


def zscore_stats(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: population mean and deviation per feature, zero deviation read as 1."""
    columns = columns or FEATURES
    pairs = []
    for c in columns:
        sd = F.stddev_pop(F.col(c).cast("double"))
        pairs.append(F.struct(
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("std")).alias(c))
    return features.agg(F.struct(*pairs).alias("stats"))


def zscores(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or FEATURES
    stats = zscore_stats(features, columns).scalar()
    return (features.withColumn("_s", stats)
            .withColumns({c: (F.col(c).cast("double") - F.col("_s").getField(c).getField("mean"))
                          / F.col("_s").getField(c).getField("std") for c in columns})
            .drop("_s"))
