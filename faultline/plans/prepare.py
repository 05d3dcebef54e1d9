"""Batch jobs around the operators: prepare logs, train, build an index, evaluate (3.1, 3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE, CONTAMINATION, RETRIEVE_TOP_K
from ..operators import metrics
from ..operators.chunking import chunk_documents
from ..operators.clean import preprocess_logs
from ..operators.features import create_features
from ..operators.forest import Forest, predict, prepare_training_data, train
from ..operators.incidents import join_labels
from ..operators.retrieval import Embedder, Index, build_index, hash_embed, retrieve
from ..operators.validate import require_valid
from ..sources import store
from ..sources.documents import load_documents
from ..sources.logs import load_all
from ..sources.materialize import materialize


def prepare(spark: SparkSession, raw_dir: str, out: str, window: str,
            strict: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """Raw folder to validated, cleaned, windowed tables; the lines are written once and re-read."""
    raw = load_all(spark, raw_dir, strict=False).structured
    report = require_valid(raw, strict)
    lines = preprocess_logs(raw, window)
    base = out.rstrip("/")
    store.write_lines(lines.drop("pos"), out)
    stored = spark.read.parquet(f"{base}/logs").drop("date")
    create_features(stored).write.mode("overwrite").parquet(f"{base}/features")
    return *store.read_prepared(spark, out), report


def train_model(spark: SparkSession, features_path: str, model_path: str, window: str,
                contamination: float | str = CONTAMINATION) -> tuple[Forest, DataFrame]:
    """Features (or raw lines) to a saved model and its summary row (M5, M6)."""
    table = prepare_training_data(spark.read.parquet(features_path), window)
    model = train(table, contamination=contamination)
    store.save_model(spark, model, model_path)
    return model, metrics.unsupervised_summary(predict(model, table), contamination=contamination)


def index_documents(spark: SparkSession, folder: str, out: str, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, embedder: Embedder = hash_embed) -> Index:
    """Documents to a saved index; everything else is built from the written chunks."""
    chunks = materialize(chunk_documents(load_documents(spark, folder), size, overlap), "chunks")
    if chunks.isEmpty():
        raise ValueError("No chunks were produced from the documents.")
    store.save_index(build_index(chunks, embedder), out)
    return store.load_index(spark, out, embedder)


def evaluate_detector(model: Forest, table: DataFrame, labels: DataFrame | None = None,
                      key: str = "time_window", factor: float = 10.0,
                      top_k: int | None = None) -> DataFrame:
    """Unsupervised, synthetic and (with labels) labelled sections as (section, metric, value)."""
    parts = {
        "unsupervised": metrics.unsupervised_summary(
            predict(model, table), contamination=model.params.get("contamination")),
        "synthetic": metrics.synthetic_report(
            predict(model, metrics.inject_synthetic(table, key, factor=factor)), top_k),
    }
    if labels is not None:
        labelled = join_labels(table, labels)
        if labelled.isEmpty():
            raise ValueError("No feature windows matched any label.")
        metrics.require_binary(labelled)
        parts["labeled"] = metrics.labelled_report(predict(model, labelled))
    return metrics.combined_report(**parts)


def evaluate_retrieval(index: Index, cases: DataFrame, top_k: int = RETRIEVE_TOP_K,
                       **options) -> tuple[DataFrame, DataFrame]:
    """One-row summary and per-case rows; the relevance cut is off."""
    settings = {"max_distance": float("inf"), "min_bm25": 0.0, **options}
    hits = retrieve(index, cases.select("query_id", "query"), top_k, **settings)
    return metrics.retrieval_report(hits, cases, top_k), metrics.retrieval_cases(hits, cases)
