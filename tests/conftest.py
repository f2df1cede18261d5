import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("textwarden-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def units(spark):
    """Builds ``(doc_id, text)`` or ``(doc_id, text, path)`` from texts or pairs."""

    def build(items):
        if items and isinstance(items[0], tuple):
            rows = [(i, t, p) for i, (t, p) in enumerate(items)]
            return spark.createDataFrame(rows, "doc_id INT, text STRING, path STRING")
        return spark.createDataFrame(list(enumerate(items)), "doc_id INT, text STRING")

    return build
