"""The shape of a registered query."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    """A query over the given tables and, where SQL can say it, the SQL of the same result."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
