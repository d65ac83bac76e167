"""Shared storage for lineage cuts, stream checkpoints and snapshot writes.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever launches the job).  Only when that is unset - local tests - do we
create a scratch folder of our own.  Nothing here ever uses a machine-local
folder on a cluster, and ``localCheckpoint`` is never used: a lost executor
would lose those blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # Unset in a local run: make a fresh scratch folder for this session.
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared root (one per call)."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
