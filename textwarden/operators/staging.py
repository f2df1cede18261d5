"""Intermediate results that must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Tables up to this size, as JSON text, are sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session, whose tasks all see this machine, falls back to a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="textwarden-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder; they outlive the executors that made them."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> int:
    """The size of the rows as JSON text, in bytes."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Writes the rows once, measures them, and marks them for broadcast if they are small.

    Otherwise the join shuffles.  Without the measure Spark would have to guess the size
    of a computed table, and could start to shuffle whole texts to meet a few rows.
    """
    kept = stage(df)
    return F.broadcast(kept) if measured(kept) <= max_bytes else kept
