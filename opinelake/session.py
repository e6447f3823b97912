"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "opinelake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # No stack capture per column expression; plans are built about twice as fast.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # 128 MB scan splits; AQE merges small shuffle partitions afterwards.
        "spark.sql.files.maxPartitionBytes": "134217728",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    such a folder would not be visible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # a local cluster has processes of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="opinelake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder path under the shared root."""
    return f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"
