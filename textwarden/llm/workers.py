"""Where Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets workers look where the driver found the package, if they share that folder.

    On a cluster without it, ship the package with ``--py-files``.
    """
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark
