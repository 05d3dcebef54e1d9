"""Explicit schemas; nothing is inferred on read."""

from pyspark.sql import types as T

from .constants import FEATURES

LOG_SCHEMA = T.StructType([
    T.StructField("LineId", T.LongType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Pid", T.LongType()),
    T.StructField("Level", T.StringType()),
    T.StructField("Component", T.StringType()),
    T.StructField("Content", T.StringType()),
    T.StructField("EventId", T.StringType()),
    T.StructField("EventTemplate", T.StringType()),
])
TEMPLATE_SCHEMA = T.StructType([
    T.StructField("EventId", T.StringType()),
    T.StructField("EventTemplate", T.StringType()),
])
FEATURE_SCHEMA = T.StructType(
    [T.StructField("time_window", T.TimestampNTZType())]
    + [T.StructField(f, T.DoubleType() if f.endswith("_ratio") else T.LongType()) for f in FEATURES]
)
LABEL_SCHEMA = T.StructType([
    T.StructField("time_window", T.TimestampNTZType()),
    T.StructField("label", T.IntegerType()),
])
EVAL_CASE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("expected_source", T.StringType()),
])
NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("feature", T.IntegerType(), False),
    T.StructField("threshold", T.DoubleType(), False),
    T.StructField("left_id", T.IntegerType(), False),
    T.StructField("right_id", T.IntegerType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("depth", T.IntegerType(), False),
])
