"""Rules that change over time: every row is scanned with those that held when it was made.

A version is a whole list of definitions and the time from which it holds, until the next
one does.  Rows before the first version are scanned with the built-in rules alone, and so
are rows without a time.  Since a row's rules follow from its own time, it gets the same
result whenever it is scanned: in batch, in a stream, or again after a failure.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.rules import MAX_TEXT_BYTES, Rule, builtin_rules
from textwarden.operators.custom_rules import MAX_CUSTOM_RULES, collect_rules, compile_rules
from textwarden.operators.monitor import narrow_ticks

#: Each version is a branch of the plan with all its rules; a longer history is worked off in spans of time.
MAX_VERSIONS = 32


class RuleVersion(NamedTuple):
    since: dt.datetime
    rules: tuple[Rule, ...]


def rule_versions(definitions: DataFrame, max_custom: int | None = MAX_CUSTOM_RULES) -> tuple[RuleVersion, ...]:
    """The versions in a table of definitions with the time ``since`` which each list holds.

    A definition that holds in two versions stands there twice.  A version in which the
    built-in rules are alone has one row without a regex.
    """
    times = [r.since for r in definitions.select("since").filter("since IS NOT NULL").distinct().orderBy("since").limit(MAX_VERSIONS + 1).collect()]
    if len(times) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions of the rules; scan one span of time after the other")
    return tuple(
        RuleVersion(t, collect_rules(compile_rules(
            definitions.filter((F.col("since") == F.lit(t)) & F.col("regex").isNotNull()).drop("since"), max_custom, key=None
        )))
        for t in times
    )


def _spans(versions: Sequence[RuleVersion], time: str) -> list[tuple[Column, tuple[Rule, ...]]]:
    at = F.col(time)
    since = [F.lit(v.since) for v in versions]
    known = [v.rules for v in versions]
    out = [((at < since[0]) | at.isNull(), builtin_rules())]
    for k, rules in enumerate(known):
        out.append(((at >= since[k]) & (at < since[k + 1]) if k + 1 < len(since) else at >= since[k], rules))
    return out


def narrow_as_of(
    rows: DataFrame, versions: Sequence[RuleVersion], max_bytes: int = MAX_TEXT_BYTES, time: str = "ts"
) -> DataFrame:
    """``narrow_ticks`` with each row's own rules.

    Scores are doubles, as weights may be whole in one version and not in another.
    """
    if not versions:
        return narrow_ticks(rows, None, max_bytes).withColumn("score", F.col("score").cast("double"))
    versions = sorted(versions, key=lambda v: v.since)
    parts = [narrow_ticks(rows.filter(span), rules, max_bytes) for span, rules in _spans(versions, time)]
    out = parts[0].withColumn("score", F.col("score").cast("double"))
    for part in parts[1:]:
        out = out.unionByName(part.withColumn("score", F.col("score").cast("double")))
    return out
