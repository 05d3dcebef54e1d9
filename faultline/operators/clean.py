"""Row-level cleaning: duplicates, clock, level, signals, windows (N1..N9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ERROR_LEVELS, REQUIRED_COLUMNS, SIGNALS
from ..functions.text import strip
from ..functions.timeparse import parse_clock, window_interval

PROCESSING_COLUMNS = [c for c in REQUIRED_COLUMNS if c != "EventTemplate"]


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def drop_blank_rows(df: DataFrame, pos: str = "pos") -> DataFrame:
    data = [c for c in df.columns if c != pos]
    return df.dropna(how="all", subset=data)


def first_per_line_id(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep the earliest row of each LineId, null LineIds counting as one id.

    An exact copy shares its LineId, and the earliest row of a LineId is never itself a later copy,
    so this one pass also removes exact duplicates. `row_number = 1` is planned as a group limit
    before the shuffle: each map task sends at most one row per LineId, so a hot id cannot pile up.
    """
    if "LineId" not in df.columns:
        data = [c for c in df.columns if c != pos]
        order = Window.partitionBy(*data).orderBy(F.col(pos))
    else:
        order = Window.partitionBy("LineId").orderBy(F.col(pos))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def clean_logs(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Drop all-null rows, exact duplicates and repeated LineIds."""
    return first_per_line_id(drop_blank_rows(df, pos), pos)


def parse_timestamp(df: DataFrame) -> DataFrame:
    """Add Timestamp and its clock parts."""
    require(df, ["Date", "Time"])
    df = df.withColumn("Timestamp", parse_clock(F.col("Date"), F.col("Time")))
    return df.withColumns({
        "hour": F.hour("Timestamp"), "minute": F.minute("Timestamp"), "second": F.second("Timestamp"),
    })


def level_expr(col: Column) -> Column:
    text = F.upper(strip(F.coalesce(col, F.lit("UNKNOWN"))))
    return (F.when(text == "", F.lit("UNKNOWN"))
            .when(text == "WARNING", F.lit("WARN"))
            .otherwise(text))


def normalize_log_level(df: DataFrame) -> DataFrame:
    """Upper-case levels; WARNING becomes WARN, missing or blank becomes UNKNOWN."""
    require(df, ["Level"])
    return df.withColumn("Level", level_expr(F.col("Level")))


def extract_log_features(df: DataFrame) -> DataFrame:
    """0/1 level flags, content signals, and signal-on-error flags."""
    require(df, ["Level", "Content"])
    level = F.upper(strip(F.coalesce(F.col("Level"), F.lit("UNKNOWN"))))
    text = F.lower(F.coalesce(F.col("Content"), F.lit("")))
    severe = level.isin(ERROR_LEVELS)
    flags = {
        "is_error": level == "ERROR",
        "is_warning": level.isin("WARN", "WARNING"),
        "is_info": level == "INFO",
        "is_fatal": level == "FATAL",
    }
    for name, pattern, row_flag, _ in SIGNALS:
        flags[f"{name}_signal"] = text.rlike(pattern)
    df = df.withColumns({k: v.cast("int") for k, v in flags.items()})
    return df.withColumns({
        row_flag: (severe & (F.col(f"{name}_signal") == 1)).cast("int")
        for name, _, row_flag, _ in SIGNALS
    })


def create_time_windows(df: DataFrame, window: str) -> DataFrame:
    """Drop untimed rows and add the epoch-aligned window start."""
    require(df, ["Timestamp"])
    start = F.window("Timestamp", window_interval(window)).getField("start")
    return df.filter(F.col("Timestamp").isNotNull()).withColumn("time_window", start)


def preprocess_logs(df: DataFrame, window: str, pos: str = "pos") -> DataFrame:
    """Raw lines to clean, flagged, windowed lines.

    Row-wise columns are computed before the LineId shuffle, so a consumer that needs only flags
    (the window features) never shuffles the message text. Untimed rows go after the shuffle: a
    LineId whose first row is untimed is dropped as a whole.
    """
    require(df, PROCESSING_COLUMNS)
    return (df
            .transform(lambda d: drop_blank_rows(d, pos))
            .transform(parse_timestamp)
            .transform(normalize_log_level)
            .transform(extract_log_features)
            .transform(lambda d: first_per_line_id(d, pos))
            .transform(lambda d: create_time_windows(d, window)))
