"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from textwarden.operators.staging import shared_folder


def written(df: DataFrame) -> DataFrame:
    """Writes the rows once as Parquet to the shared folder, and reads them from there.

    Unlike a checkpoint, the table is compressed, is read by column, and does not pass on
    the constraints of the plan that made it, which grow from round to round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
