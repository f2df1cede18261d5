import pytest
from pyspark.sql import functions as F

from .samples import CLASHING, SCHEMA, messy_rows


@pytest.fixture(scope="session")
def messy(spark):
    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
