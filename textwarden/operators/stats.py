"""Corpus-wide summaries of findings.

All of them count with partial aggregation before the shuffle, so a source holding
most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detect import with_matched
from textwarden.functions.rules import Rule

LEVELS = ("LOW", "MEDIUM", "HIGH")


def rule_hits(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text"
) -> DataFrame:
    """One row per unit and matched rule with the number of hits, without the text."""
    found = with_matched(df, rules, text, only_found=True)
    kept = [c for c in df.columns if c != text]
    counted = found.select(
        *kept,
        F.inline(
            F.transform(
                "matched",
                lambda r: F.struct(
                    r["ord"].alias("ord"),
                    r["id"].alias("rule_id"),
                    r["label"].alias("label"),
                    F.regexp_count(F.col(text), r["regex"]).alias("occurrences"),
                ),
            )
        ),
    )
    return counted


def rule_hit_stats(
    df: DataFrame,
    by: Sequence[str] = (),
    rules: Sequence[Rule] | None = None,
    text: str = "text",
) -> DataFrame:
    """Units and hits per rule and group.  A unit meets a rule once, so units are counted."""
    return (
        rule_hits(df.select(*by, text), rules, text)
        .groupBy(*by, "rule_id", "label")
        .agg(F.count("*").alias("units"), F.sum("occurrences").alias("hits"))
    )


def _grouped(df, by, rules, text, grouping):
    base = rule_hit_stats(df, by, rules, text)
    names = (*by, "rule_id")
    flags = F.grouping_id().alias("level_id")
    return getattr(base, grouping)(*names).agg(
        flags, F.sum("units").alias("unit_hits"), F.sum("hits").alias("hits")
    )


def rule_hit_cube(
    df: DataFrame,
    by: Sequence[str] = ("source", "lang"),
    rules: Sequence[Rule] | None = None,
    text: str = "text",
) -> DataFrame:
    """Hits for every combination of the group columns and the rule.

    Counts are summed per finest group first, so the grouping sets expand a small table
    and not the corpus.
    """
    return _grouped(df, by, rules, text, "cube")


def rule_hit_rollup(
    df: DataFrame,
    by: Sequence[str] = ("source", "lang"),
    rules: Sequence[Rule] | None = None,
    text: str = "text",
) -> DataFrame:
    return _grouped(df, by, rules, text, "rollup")


def risk_summary(scored: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Units per group and level with mean and highest score."""
    return scored.groupBy(*by, "level").agg(
        F.count("*").alias("units"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
    )


def risk_pivot(scored: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Units per level as columns, one row per group."""
    counts = [
        F.count_if(F.col("level") == level).alias(f"{level.lower()}_units") for level in LEVELS
    ]
    return scored.groupBy(*by).agg(
        *counts, F.count("*").alias("units"), F.max("score").alias("max_score")
    )
