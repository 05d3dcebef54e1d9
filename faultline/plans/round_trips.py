"""What the sources and sinks write is read back, and compared like any other result."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURES
from ..operators import forest, retrieval
from ..sources import documents, logs, store
from ..sources.materialize import scratch_path
from ..sources.tables import log_lines, table
from . import fixed_forest, prepare

#: Lines of these ids get a line break and a quote inside their message.
BREAKS = 13


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that every task can read and write."""
    path = scratch_path(spark, label)
    if path is None:
        raise ValueError("A shared folder is needed: set spark.checkpoint.dir.")
    return path


def _broken(col: str = "Content"):
    return F.when(F.col("LineId") % BREAKS == 0, F.concat(F.col(col), F.lit('\n"second" line'))).otherwise(F.col(col))


def _write_csv(lines: DataFrame, folder: str) -> None:
    """CSV files in the order of `pos`: the file order is the ingest order."""
    ordered = lines.repartitionByRange("pos", "LineId").sortWithinPartitions("pos", "LineId").drop("pos")
    ordered.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{logs.STRUCTURED_FILE}")


def csv_lines(spark, sf):
    """Structured lines through CSV, messages with quoted line breaks included."""
    folder = shared_folder(spark, "csv")
    _write_csv(log_lines(spark, sf).withColumn("Content", _broken()), folder)
    found = logs.load_structured_logs(spark, f"{folder}/{logs.STRUCTURED_FILE}")
    return found.groupBy(*[c for c in found.columns if c != "pos"]).agg(F.count(F.lit(1)).alias("n"))


def csv_damage(spark, sf):
    """Records cut short, with a field too many, or over two lines are counted; the others read as they are."""
    folder, lines = shared_folder(spark, "csv"), log_lines(spark, sf)
    names = [c for c in lines.columns if c != "pos"]
    text = F.to_csv(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]))
    cut = F.when(F.col("LineId") % 101 == 5, F.substring_index(text, ",", 4)).when(F.col("LineId") % 103 == 7, F.concat(text, F.lit(",more")))

    def with_header(batches):
        yield pa.RecordBatch.from_arrays([pa.array([",".join(names)])], ["value"])
        yield from batches

    plain = lines.select(F.coalesce(cut, text).alias("value"))
    plain.mapInArrow(with_header, "value string").write.text(f"{folder}/{logs.STRUCTURED_FILE}")
    spanning = lines.filter(F.col("LineId") % BREAKS == 0).withColumn("Content", _broken())
    spanning.drop("pos").write.mode("append").option("header", True).option("escape", '"').csv(f"{folder}/{logs.STRUCTURED_FILE}")
    found = logs.damaged_records(spark, f"{folder}/{logs.STRUCTURED_FILE}")
    return found.agg(F.sum("n_records").alias("n_records"), F.sum("n_damaged").alias("n_damaged"))


def raw_lines(spark, sf):
    """Raw lines through text files."""
    folder = shared_folder(spark, "raw-lines")
    log_lines(spark, sf).select(F.coalesce("Content", F.lit("")).alias("value")).write.text(f"{folder}/{logs.RAW_FILE}")
    return logs.load_raw_logs(spark, f"{folder}/{logs.RAW_FILE}").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def template_rows(spark, sf):
    """The template dictionary through CSV (S3)."""
    folder = shared_folder(spark, "templates")
    log_lines(spark, sf).select("EventId", "EventTemplate").distinct().write.option("header", True).csv(f"{folder}/{logs.TEMPLATES_FILE}")
    return logs.load_templates(spark, f"{folder}/{logs.TEMPLATES_FILE}")


def _write_files(rows: DataFrame, folder: str) -> None:
    """Files of (name, text) in folders by name, as the text writer gives them; rows of a name are lines of its file.

    Where tasks can open the folder they write its files directly: the writer's steps for each of very many
    folders, a process for the rights of each file and a move of each folder by the driver, take far longer.
    """
    placed = rows.repartition("name")
    if "://" in folder.removeprefix("file://"):
        placed.write.partitionBy("name").text(folder)
        return
    root = "/" + folder.removeprefix("file:").lstrip("/")

    def write(batches):
        n, last = 0, None
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = f"{root}/name={name}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/part.txt", "a" if name == last else "w", encoding="utf-8", newline="") as file:
                    file.write(f"{text or ''}\n")
                n, last = n + 1, name
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    os.makedirs(root, exist_ok=True)
    named = placed.withColumn("name", F.coalesce("name", F.lit("__HIVE_DEFAULT_PARTITION__"))).sortWithinPartitions("name")
    named.mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def _document_folder(spark, sf) -> str:
    """`documents` as a file each, in a folder each; every 50th is blank."""
    folder = shared_folder(spark, "documents")
    blank = F.when(F.col("doc_id") % 50 == 0, F.lit(" \t ")).otherwise(F.col("text"))
    _write_files(table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("name"), blank.alias("text")), folder)
    return folder


def _named(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(F.regexp_extract("source", "name=([^/]+)/", 1).alias("name"), *columns)


def folder_documents(spark, sf):
    """Documents read from a folder tree, blank ones left out."""
    docs = documents.load_documents(spark, _document_folder(spark, sf), "*.txt")
    count = documents.document_count(docs).scalar()
    found = docs.join(documents.document_names(docs), "source")
    return _named(found, F.md5("content").alias("digest")).withColumn("n_documents", count)


def skipped_documents(spark, sf):
    """Documents of a folder tree that aren't usable, with the reason."""
    return _named(documents.skipped_documents(spark, _document_folder(spark, sf), "*.txt"), "reason")


def prepared_features(spark, sf):
    """Raw folder to stored features: load, gate, clean, write, read."""
    folder = shared_folder(spark, "raw")
    _write_csv(log_lines(spark, sf), folder)
    _, features, _ = prepare.prepare(spark, folder, shared_folder(spark, "prepared"), "10min")
    return features.select("time_window", *[F.round(c, 6).alias(c) if c.endswith("_ratio") else F.col(c) for c in FEATURES])


def stored_model_scores(window_table):
    def run(spark, sf):
        """Scores of a model that was saved and loaded."""
        path = shared_folder(spark, "model")
        store.save_model(spark, fixed_forest.model(), path)
        scored = forest.predict(store.load_model(spark, path), window_table(spark, sf))
        return scored.select("time_window", F.round("decision", 6).alias("decision"), F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")
    return run


def stored_index_top(document_index, benchmark_queries):
    def run(spark, sf):
        """BM25 over an index that was saved and loaded; only the asked buckets of postings are read."""
        path = shared_folder(spark, "index")
        store.save_index(document_index(spark, sf), path)
        top = retrieval.bm25_top(store.load_index(spark, path), benchmark_queries(spark, sf))
        return top.select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"), "sparse_rank")
    return run


def report_rows(spark, sf):
    """Report rows through JSON; non-finite numbers become null."""
    path = shared_folder(spark, "report")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    store.write_report(rows, path)
    return spark.read.schema("event_id bigint, value double").json(path)


def queries(window_table, document_index, benchmark_queries) -> dict:
    return {"csv_lines": csv_lines, "csv_damage": csv_damage, "raw_lines": raw_lines, "template_rows": template_rows,
            "folder_documents": folder_documents, "skipped_documents": skipped_documents, "prepared_features": prepared_features, "stored_model_scores": stored_model_scores(window_table),
            "stored_index_top": stored_index_top(document_index, benchmark_queries), "report_rows": report_rows}


def oracle(sql: dict[str, str], log: str) -> dict[str, str]:
    """`sql` holds the queries' SQL without the round trip; `log` is a WITH clause that ends in the lines."""
    names = ["LineId", "Date", "Time", "Pid", "Level", "Component", "EventId", "EventTemplate"]
    cols = ", ".join(f'"{c}"' for c in names)
    broken = f"""CASE WHEN "LineId" % {BREAKS} = 0 THEN "Content" || chr(10) || '"second" line' ELSE "Content" END"""
    return {
        "csv_lines": log + f'SELECT {cols}, {broken} AS "Content", count(*) AS n FROM log GROUP BY ALL',
        "csv_damage": log + f"""SELECT sum(1 + ("LineId" % {BREAKS} = 0)::INT)::BIGINT AS n_records,
            count(*) FILTER ("LineId" % 101 = 5 OR "LineId" % 103 = 7)::BIGINT AS n_damaged FROM log""",
        "raw_lines": log + """SELECT coalesce("Content", '') AS line, count(*) AS n FROM log GROUP BY 1""",
        "template_rows": log + 'SELECT DISTINCT "EventId", "EventTemplate" FROM log',
        "folder_documents": "SELECT 'doc_' || doc_id AS name, md5(text || chr(10)) AS digest, count(*) OVER () AS n_documents FROM documents "
                            "WHERE doc_id % 50 <> 0 AND regexp_matches(text, '\\S')",
        "skipped_documents": "SELECT 'doc_' || doc_id AS name, 'empty' AS reason FROM documents WHERE doc_id % 50 = 0 OR NOT regexp_matches(text, '\\S')",
        "prepared_features": sql["window_features"],
        "stored_model_scores": sql["fixed_forest_scores"],
        "stored_index_top": sql["bm25_top"],
        "report_rows": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events",
    }
