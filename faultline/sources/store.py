"""Persisted results: prepared tables, models, indexes, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import Forest
from ..operators.retrieval import Embedder, Index, corpus_stats, hash_embed, term_bucket
from ..schemas import NODE_SCHEMA

MODEL_FIELDS = {"columns", "medians", "offset", "scale", "subsample", "params"}


def write_lines(lines: DataFrame, out: str) -> None:
    """Clean lines by date (S7); rows of a date are brought together, a busy date in several files."""
    (lines.withColumn("date", F.to_date("Timestamp")).hint("rebalance", "date").write.mode("overwrite")
     .partitionBy("date").parquet(f"{out.rstrip('/')}/logs"))


def read_prepared(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    base = out.rstrip("/")
    return spark.read.parquet(f"{base}/logs").drop("date"), spark.read.parquet(f"{base}/features")


def save_model(spark: SparkSession, model: Forest, path: str) -> None:
    """Node table and one parameter row; nothing executable is stored."""
    base = path.rstrip("/")
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{base}/nodes")
    row = (json.dumps(model.columns), json.dumps(model.medians), model.offset, model.scale,
           model.subsample, json.dumps(model.params))
    spark.createDataFrame([row], "columns string, medians string, offset double, scale double, "
                                 "subsample bigint, params string").coalesce(1).write.mode(
        "overwrite").parquet(f"{base}/params")


def load_model(spark: SparkSession, path: str) -> Forest:
    base = path.rstrip("/")
    try:
        params = spark.read.parquet(f"{base}/params")
        nodes = spark.read.parquet(f"{base}/nodes")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"Model not found: {path}") from exc
        raise ValueError(f"Could not read model {path}: {exc}") from exc
    if not MODEL_FIELDS <= set(params.columns) or set(nodes.columns) != set(NODE_SCHEMA.names):
        raise ValueError(f"{path} is not a valid model.")
    p = params.first()
    table = nodes.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
    return Forest(table, json.loads(p["columns"]), json.loads(p["medians"]), p["offset"], p["scale"],
                  p["subsample"], json.loads(p["params"]))


def save_index(index: Index, path: str) -> None:
    """Index tables (S9); postings lie in folders by term bucket, so asked terms read few of them."""
    base = path.rstrip("/")
    index.chunks.write.mode("overwrite").parquet(f"{base}/chunks")
    (index.postings.withColumn("bucket", term_bucket(F.coalesce("term", F.lit(""))))
     .repartitionByRange("bucket", "term", "chunk_id").sortWithinPartitions("bucket", "term", "chunk_id")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings"))
    index.terms.write.mode("overwrite").parquet(f"{base}/terms")
    index.vectors.write.mode("overwrite").parquet(f"{base}/vectors")


def load_index(spark: SparkSession, path: str, embedder: Embedder = hash_embed) -> Index:
    base = path.rstrip("/")
    try:
        chunks, post, terms, vectors = (spark.read.parquet(f"{base}/{name}")
                                        for name in ("chunks", "postings", "terms", "vectors"))
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"Index not found at {path}; build it first.") from exc
        raise
    return Index(chunks, post, terms, vectors, corpus_stats(post)[1], embedder)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON, non-finite numbers as null."""
    from ..functions.numeric import finite
    clean = report.withColumns({c: finite(F.col(c)) for c, t in report.dtypes if t == "double"})
    clean.write.mode("overwrite").json(path)
