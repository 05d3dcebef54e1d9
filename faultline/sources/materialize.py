"""Written intermediates: cut a long lineage with a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def scratch_path(spark: SparkSession, label: str) -> str | None:
    """A fresh path below the folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a new temporary folder. On a cluster there is then no
    path: a machine-local folder is not shared.
    """
    base = shared_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            return None
        base = tempfile.mkdtemp(prefix="faultline-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back, so a lost executor costs no recomputation of its lineage.

    Without a shared folder the plan is returned as it is: right, only recomputed.
    """
    path = scratch_path(df.sparkSession, label)
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
