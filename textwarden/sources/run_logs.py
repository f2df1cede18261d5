"""Diagnoses and run reports kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_BATCH = "log_batch"
#: Overwriting touches the partitions that are written, no others.
_ONLY_THESE = ("partitionOverwriteMode", "dynamic")


def append_diagnoses(diagnoses: DataFrame, path: str, batch: int | None = None) -> None:
    """Adds diagnoses to the log.

    With the number of a batch the batch is written once: trying it again replaces what it
    wrote, and leaves all other batches as they are.  Without, rows are added every time.
    """
    numbered = diagnoses.withColumn(_BATCH, F.lit(batch).cast("bigint"))
    writer = numbered.write.partitionBy(_BATCH)
    if batch is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option(*_ONLY_THESE).parquet(path)


def load_diagnoses(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log so far; a log that does not exist yet is empty."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([], schema).unionByName(stored.drop(_BATCH), allowMissingColumns=True)


def write_run_report(summary: DataFrame, path: str) -> None:
    """One JSON report per run, in a folder named after it; a run reported again is replaced."""
    named = summary.select("*", F.col("run_id").alias("run"))
    named.write.mode("overwrite").option(*_ONLY_THESE).partitionBy("run").json(path)
