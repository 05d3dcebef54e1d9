"""Session defaults. Everything here is a setting a cluster operator may override."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods over 8000 bytes of bytecode; a stage that large runs faster
    # split into operators than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "faultline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, app: str = "faultline-local", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench: few shuffle partitions, no web UI."""
    return build_session(
        app, f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": memory,
            # Small inputs on few cores: keep every core busy instead of merging into one task.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.files.openCostInBytes": "65536",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": os.path.join("/tmp", f"faultline-{os.getpid()}"),
        },
    )


def shared_dir(spark: SparkSession) -> str | None:
    """Shared folder named by the cluster for materialised intermediates (None when unset)."""
    return spark.conf.get("spark.checkpoint.dir", None)
