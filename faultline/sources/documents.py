"""Knowledge documents and retrieval cases."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVAL_CASES
from ..schemas import EVAL_CASE_SCHEMA
from .materialize import materialize

#: Folders that a task looks through, files and bytes that it reads, on average; bytes and rows that it hands on at a time.
TASK_FOLDERS, TASK_FILES, TASK_BYTES = 10_000, 10_000, 32 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4_096


def _opened_folder(spark: SparkSession, root: str, pattern: str) -> str | None:
    """The folder's path where tasks can open it and names are matched by * and ? alone, else None: then Spark's reader lists it."""
    path = re.sub("^file:/*", "/", root)
    if "://" in path or set(path) & set("*?[]{}\\") or set(pattern) & set("[]{}\\"):
        return None
    if path == root and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:"):
        return None
    path = os.path.abspath(path)
    return path if os.path.isdir(path) else None


def _looked_through(pattern: str):
    """Task: (path, size) of the files in each folder, and of its folders with no size; like Spark's readers, without hidden and empty files."""
    match = re.compile(fnmatch.translate(pattern)).match

    def rows(folder: str) -> Iterator[tuple[str, int | None]]:
        with os.scandir(folder) as entries:
            for entry in entries:
                name = entry.name
                hidden = name.startswith(".") or name.startswith("_") and "=" not in name
                if entry.is_dir():
                    if not (hidden or name.endswith("._COPYING_")) or name.startswith(("_metadata", "_common_metadata")):
                        yield entry.path, None
                elif not hidden and not name.endswith("._COPYING_") and match(name):
                    try:
                        size = entry.stat().st_size
                    except FileNotFoundError:
                        continue
                    if size:
                        yield entry.path, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes = [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for path, size in rows(folder):
                    paths.append(path)
                    sizes.append(size)
                    if len(paths) >= BATCH_ROWS:
                        yield out()
                        paths, sizes = [], []
        yield out()
    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: files with what they hold."""
    paths, held, n = [], [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open(path, "rb") as file:
                held.append(file.read())
            paths.append(path)
            n += len(held[-1])
            if n >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                yield out()
                paths, held, n = [], [], 0
    yield out()


def _files_below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of a folder's files, level by level: tasks list the folders of a level, and write what they find.

    The driver holds no names, only how many there are; files are then dealt out by their number and size.
    """
    cores = spark.sparkContext.defaultParallelism
    folders, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = materialize(folders.mapInArrow(_looked_through(pattern), "path string, size bigint"), "level")
        here = level.filter("size IS NOT NULL")
        files = here if files is None else files.unionByName(here)
        deeper = level.filter("size IS NULL").select("path")
        n = deeper.count()
        if not n:
            break
        folders = deeper.repartition(min(n, max(cores, -(-n // TASK_FOLDERS))), "path")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, min(n, max(cores, -(-n // TASK_FILES), -(-size // TASK_BYTES))))
    return files.select("path").repartition(parts, "path").mapInArrow(_contents, "path string, content binary")


def _read(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source, path, content) of the files below a folder.

    Spark's reader keeps the status of every file on the driver; it is left to stores that only Spark reads.
    """
    root = folder.rstrip("/")
    opened = _opened_folder(spark, root, pattern)
    if opened:
        files, root = _files_below(spark, opened, pattern), opened
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", pattern).load(root))
        root = re.sub("^file:/*", "/", root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        F.substring(path, F.length(F.lit(root)) + 2, F.length(path)).alias("source"),
        path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def load_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Usable documents below a folder; source is the relative path (S5). The files are opened once."""
    docs = materialize(_read(spark, folder, pattern).filter(F.col("content").rlike(r"\S")), "documents")
    if docs.isEmpty():
        raise ValueError(f"No usable {pattern.lstrip('*')} documents found in {folder}")
    return docs


def skipped_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Blank documents that load_documents leaves out, with the reason."""
    return (_read(spark, folder, pattern).filter(~F.col("content").rlike(r"\S"))
            .select("source", "path", F.lit("empty").alias("reason")))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_documents"))


def document_names(docs: DataFrame) -> DataFrame:
    return docs.select("source").orderBy("source")


def load_eval_cases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(query_id, query, expected_source) from a JSON list, or the default cases."""
    if path is None:
        return spark.createDataFrame(
            [(i, q, s) for i, (q, s) in enumerate(EVAL_CASES)],
            "query_id bigint, query string, expected_source string")
    cases = spark.read.schema(EVAL_CASE_SCHEMA).option("multiLine", True).json(path)
    figures = cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("query").isNull() | F.col("expected_source").isNull()).alias("bad")).first()
    if figures["n"] == 0:
        raise ValueError(f"{path} must contain a non-empty JSON list of cases.")
    if figures["bad"]:
        raise ValueError(f"{figures['bad']} item(s) in {path} lack 'query' or 'expected_source'.")
    return cases.withColumn("query_id", F.monotonically_increasing_id())
