"""The given Parquet tables, seen through the log and knowledge schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CAUSES

# Short runbooks, one per cause key.
RUNBOOKS = [
    ("hdfs_datanode_failure.md",
     "A DataNode that stops sending heartbeats to the NameNode is marked dead; check the process, "
     "its memory and whether contact was lost after a crash."),
    ("hdfs_namenode_failure.md",
     "A NameNode stuck in safe mode after a restart often failed to load the fsimage or edit log; "
     "check standby failover as well."),
    ("hdfs_disk_failure.md",
     "No space left on device, a read-only filesystem volume, a checksum mismatch or a corrupt block "
     "on disk point to failing storage on a DataNode."),
    ("hdfs_network_failure.md",
     "Connection timed out between nodes, a socket exception with a broken pipe or an unreachable "
     "network mean clients cannot reach their peers; test the links."),
    ("hdfs_replication_failure.md",
     "Blocks are under-replicated when they could only be replicated to 0 nodes; run fsck and look "
     "for missing blocks across the cluster."),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as structured log lines plus `pos`, the ingest position.

    Copies (pos 1: exact duplicate, pos 2: repeated LineId) come from one explode, so the table is
    scanned once.
    """
    e = table(spark, sf_dir, "events")
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    clock = F.date_format("ts", "HHmmss")
    level = (
        F.when(eid % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("event_type") == "error",
              F.when(F.col("value") >= 200, F.lit("FATAL")).otherwise(F.lit("ERROR")))
        .when(F.col("event_type") == "signup", F.lit("warning"))
        .when(F.col("event_type") == "view", F.lit(" info "))
        .when(F.col("event_type") == "purchase", F.lit("DEBUG"))
        .otherwise(F.lit("INFO"))
    )
    text = eid.cast("string")
    content = (
        F.when(eid % 8 == 0, F.concat(F.lit("Receiving block blk_"), text,
                                      F.lit(" src: /10.0.0.1:50010")))
        .when(eid % 8 == 1, F.concat(F.lit("PacketResponder 1 for block blk_"), text,
                                     F.lit(" terminating")))
        .when(eid % 8 == 2, F.concat(F.lit("Lost heartbeat from datanode 10.0.0."), user))
        .when(eid % 8 == 3, F.concat(F.lit("Connection reset by peer 10.0.0."), user))
        .when(eid % 8 == 4, F.concat(F.lit("No space left on device for volume /data/"), user))
        .when(eid % 8 == 5, F.lit("NameNode is in safe mode, edit log failed to load"))
        .when(eid % 8 == 6, F.concat(F.lit("blk_"), text,
                                     F.lit(" could only be replicated to 0 nodes")))
        .otherwise(F.concat(F.lit("Verification succeeded for blk_"), text))
    )
    base = e.select(
        eid.alias("LineId"),
        F.date_format("ts", "yyMMdd").alias("Date"),
        F.when(eid % 101 == 0, F.lit("999999"))
        .when(eid % 7 == 0, F.concat(clock.cast("int").cast("string"), F.lit(".0")))
        .otherwise(clock).alias("Time"),
        F.col("user_id").alias("Pid"),
        level.alias("Level"),
        F.concat(F.lit("dfs."), F.col("event_type")).alias("Component"),
        content.alias("Content"),
        F.concat(F.lit("E"), (eid % 14 + 1).cast("string")).alias("EventId"),
        F.concat(F.lit("T"), (eid % 14 + 1).cast("string")).alias("EventTemplate"),
        F.explode(F.array_compact(F.array(
            F.lit(0), F.when(eid % 50 == 0, F.lit(1)), F.when(eid % 53 == 0, F.lit(2))))).alias("pos"),
    )
    repeated = F.col("pos") == 2
    return (base
            .withColumn("Level", F.when(repeated, F.lit("INFO")).otherwise(F.col("Level")))
            .withColumn("Content", F.when(repeated, F.lit("repeated line id"))
                        .otherwise(F.col("Content"))))


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as Markdown files: a title heading and the whole text."""
    d = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        source.alias("source"), source.alias("path"),
        F.concat(F.lit("# "), source, F.lit("\n"), F.col("text")).alias("content"),
    )


def cause_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as (chunk_id, source, content); a source's name holds the key of one of the causes."""
    keys = F.array(*[F.lit(c[1]) for c in CAUSES])
    name = F.concat(F.element_at(keys, (F.col("doc_id") % len(CAUSES) + 1).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), name.alias("source"), F.col("text").alias("content"))


def sectioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with a title, and headings of rising depth before some of their own lines.

    A line starting with A..H opens a level-2 section, one starting with I..M a level-3 section, and
    lines starting with N or O are fenced as code holding a heading-like line.
    """
    d = knowledge_documents(spark, sf_dir)
    body = F.regexp_replace("content", r"(?m)^([A-H])", "## Part $1\n$1")
    body = F.regexp_replace(body, r"(?m)^([I-M])", "### Point $1\n$1")
    body = F.regexp_replace(body, r"(?m)^([NO])", "```\n# not a heading\n```\n$1")
    return d.withColumn("content", body)


def runbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, s, t) for s, t in RUNBOOKS], "source string, path string, content string")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
