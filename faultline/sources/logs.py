"""Log sources: structured CSV, raw text, template dictionary (S1..S4)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOG_SCHEMA, TEMPLATE_SCHEMA

# File names inside a log folder.
STRUCTURED_FILE = "HDFS_2k.log_structured.csv"
RAW_FILE = "HDFS_2k.log"
TEMPLATES_FILE = "HDFS_2k.log_templates.csv"


class SourceError(ValueError):
    """A source exists but cannot be used."""


def _check(spark: SparkSession, path: str) -> None:
    """Missing paths and zero-byte files are errors; file sizes come from the listing alone."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(where)
    if not found:
        raise FileNotFoundError(f"File not found: {path}")
    if sum(fs.getContentSummary(s.getPath()).getLength() for s in found) == 0:
        raise SourceError(f"File is empty: {path}")


def ingest_position() -> Column:
    """Orderable position of a row: file, block offset, row order within the scan task.

    It is a function of the files and their splits, so a retried task gives the same positions.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def _valid_text(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.make_valid_utf8(c) for c in text})


#: Text of a record that doesn't fit the header, in a column of this name.
DAMAGED = "_damaged"


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, columns matched by name, and DAMAGED: the record's text where it doesn't fit.

    Extra columns pass through as text. Only the header line is read on the driver. Where a quoted
    field holds a line break (a line with an odd number of quotes shows it), records span lines, and
    that file is read by one task; all other files stay splittable.
    """
    _check(spark, path)
    names = spark.read.option("header", True).csv(path).columns
    typed = {f.name: f for f in schema.fields}
    given = T.StructType([typed.get(n, T.StructField(n, T.StringType())) for n in names]).add(DAMAGED, T.StringType())
    text = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = {r[0] for r in text.select("value", F.col("_metadata.file_path").alias("f")).filter(quotes % 2 != 0).select("f").distinct().collect()}
    files = {_decoded(f) for f in text.inputFiles()}
    spanning = {_decoded(f) for f in odd}
    reader = (spark.read.schema(given).option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
              .option("columnNameOfCorruptRecord", DAMAGED).option("enforceSchema", True))
    parts = [reader.option("multiLine", lines).csv(sorted(found)).select("*", "_metadata")
             for lines, found in ((False, files - spanning), (True, spanning)) if found]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _decoded(uri: str) -> str:
    """A file's location in one form: listings and rows differ in percent-encoding and in slashes after the scheme."""
    return re.sub(r"^(\w+):/+(?=/)", r"\1:", unquote(uri))


def load_structured_logs(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """Structured lines with `pos`; Date and Time stay text.

    A record with too few or too many fields keeps those that fit; with `damaged`, DAMAGED holds its text.
    """
    df = _read_csv(spark, path, LOG_SCHEMA)
    columns = [c for c in df.columns if c not in ("_metadata", DAMAGED)] + ([DAMAGED] if damaged else [])
    return _valid_text(df.select(*columns, ingest_position().alias("pos")))


def damaged_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_records, n_damaged) of each file of structured lines."""
    df = load_structured_logs(spark, path, damaged=True)
    # A reader that is asked for few columns doesn't see whether the others fit: the condition names all.
    whole = F.hash(*[c for c in df.columns if c != "pos"]) >= F.lit(-(1 << 31))
    return df.groupBy(F.col("pos.file").alias("file")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col(DAMAGED).isNotNull() & whole).alias("n_damaged"))


def load_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw log, one row per line."""
    _check(spark, path)
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("line"))


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template dictionary (S3)."""
    return _valid_text(_read_csv(spark, path, TEMPLATE_SCHEMA).drop("_metadata", DAMAGED))


@dataclass(frozen=True)
class LogSources:
    structured: DataFrame
    raw: DataFrame | None
    templates: DataFrame | None


def load_all(spark: SparkSession, folder: str, strict: bool = True) -> LogSources:
    """All three sources; structured lines are always required, the others only when strict."""
    folder = folder.rstrip("/")
    structured = load_structured_logs(spark, f"{folder}/{STRUCTURED_FILE}")

    def optional(loader, name):
        try:
            return loader(spark, f"{folder}/{name}")
        except (FileNotFoundError, SourceError):
            if strict:
                raise
            return None

    return LogSources(structured, optional(load_raw_logs, RAW_FILE),
                      optional(load_templates, TEMPLATES_FILE))
