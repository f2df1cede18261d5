"""SQL text for expressions that are built from the rule table.

A rule set turns into hundreds of expression nodes.  Writing them as one SQL
expression keeps building the plan to a single parse.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lit(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    """A column name as SQL; dots are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def any_of(tests: Iterable[str]) -> str:
    """True where one test holds; no test never does."""
    return "(" + (" OR ".join(tests) or "false") + ")"


def all_of(tests: Iterable[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def computed_once(df: DataFrame, **columns: str) -> DataFrame:
    """Adds SQL expressions that run exactly once per row.

    A filter on a plain computed column is pushed below it, and Catalyst then copies the
    expression into the filter; for regex work over whole texts that costs another scan
    of the text per copy.  A generator is never copied, and yields one row here.
    """
    fields = ", ".join(f"({sql}) AS {ident(name)}" for name, sql in columns.items())
    return df.select("*", F.expr(f"inline(array(struct({fields})))"))
