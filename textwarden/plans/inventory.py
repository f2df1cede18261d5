"""Registered queries: manifests derived from ``customer``, and source listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators.manifests import (
    contributed_commands, manifest_commands, manifest_features, menu_contributions,
)
from textwarden.plans.registry import Query

QUERIES: dict[str, Query] = {}

# One manifest per customer, as SQL both engines run.  Menus are not in alphabetical
# order, one command is contributed twice, one menu item names an unknown command, and
# some entries are malformed.
_MANIFEST = """CASE WHEN c_custkey % 11 = 5 THEN c_name ELSE concat(
    '{"name": "', c_name, '", "contributes": {"commands": [',
    '{"command": "k', c_custkey, '.open", "title": "Open ', c_mktsegment, '"}, ',
    '"no entry", {"title": "no command"}, {"command": 7}, ',
    '{"command": "k', c_custkey, '.close", "title": "Close"}, null, ',
    '{"command": "k', c_custkey, '.open", "title": "Open again"}], ',
    '"menus": {"view/title": [{"command": "k', c_custkey, '.open", "when": "focus", "group": "1"}, ',
    '["no item"], 5, {"command": "k', c_custkey, '.extra", "when": "x"}], ',
    '"editor/context": [{"command": "k', c_custkey, '.open", "group": "', c_nationkey, '"}]}',
    CASE c_custkey % 3 WHEN 0 THEN ', "configuration": {"title": "T"}' WHEN 1 THEN ', "configuration": null' ELSE '' END,
    '}}') END"""
_MANIFESTS_SQL = (
    f"WITH manifests AS (SELECT c_custkey AS repo_id, c_custkey, c_name, c_nationkey, c_mktsegment, "
    f"{_MANIFEST} AS manifest FROM customer), good AS (SELECT * FROM manifests WHERE json_valid(manifest))"
)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.selectExpr("c_custkey AS repo_id", f"{_MANIFEST} AS manifest")


QUERIES["manifest_contributed"] = Query(
    lambda spark, sf_dir: contributed_commands(manifests(spark, sf_dir)).select(
        "repo_id", F.col("pos").cast("bigint").alias("pos"), "command", "title"
    ),
    _MANIFESTS_SQL + """, listed AS (SELECT repo_id, json_extract(manifest, '$.contributes.commands[*]')
      AS l FROM good), rows AS (SELECT repo_id, unnest(l) AS e, unnest(range(0, len(l))) AS pos FROM listed)
    SELECT repo_id, CAST(pos AS BIGINT) AS pos, e->>'$.command' AS command, e->>'$.title' AS title FROM rows
    WHERE json_type(e, '$.command') = 'VARCHAR'""",
)


def _commands(spark, sf_dir):
    return manifest_commands(manifests(spark, sf_dir)).select(
        "repo_id", "command", "title", "added",
        F.coalesce("when", F.lit("-")).alias("when_clause"),
        F.coalesce("group", F.lit("-")).alias("group_name"),
    )


QUERIES["manifest_commands"] = Query(
    _commands,
    _MANIFESTS_SQL + """
    SELECT repo_id, 'k' || c_custkey || '.open' AS command, 'Open ' || c_mktsegment AS title, false AS added,
      '-' AS when_clause, CAST(c_nationkey AS VARCHAR) AS group_name FROM good
    UNION ALL SELECT repo_id, 'k' || c_custkey || '.close', 'Close', false, '-', '-' FROM good
    UNION ALL SELECT repo_id, 'k' || c_custkey || '.open', 'Open again', false, '-', '-' FROM good
    UNION ALL SELECT repo_id, 'k' || c_custkey || '.extra', 'k' || c_custkey || '.extra', true, 'x', '-' FROM good""",
)
QUERIES["menu_contributions"] = Query(
    lambda spark, sf_dir: menu_contributions(manifests(spark, sf_dir)).select(
        "repo_id", F.col("menu_pos").cast("bigint").alias("menu_pos"), "type", "location"
    ),
    _MANIFESTS_SQL + """, keyed AS (SELECT repo_id, json_keys(manifest, '$.contributes.menus') AS l FROM good)
    SELECT repo_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS menu_pos, 'menu' AS type, unnest(l) AS location FROM keyed""",
)


def _features(spark, sf_dir):
    rows = manifest_features(manifests(spark, sf_dir))
    return rows.groupBy("type", "description").agg(
        F.count("*").alias("features"), F.sum(F.size("files")).alias("files")
    )


QUERIES["manifest_features"] = Query(
    _features,
    _MANIFESTS_SQL + """
    SELECT 'command' AS type, 'Open ' || c_mktsegment AS description, count(*) AS features, count(*) AS files FROM good GROUP BY 2
    UNION ALL SELECT 'command', 'Close', count(*), count(*) FROM good
    UNION ALL SELECT 'command', 'Open again', count(*), count(*) FROM good
    UNION ALL SELECT 'command', 'k' || c_custkey || '.extra', 1, 1 FROM good
    UNION ALL SELECT 'menu', 'Context menu contributions for view/title', count(*), 0 FROM good
    UNION ALL SELECT 'menu', 'Context menu contributions for editor/context', count(*), 0 FROM good
    UNION ALL SELECT 'configuration', 'User-configurable settings', count(*), 0 FROM good WHERE c_custkey % 3 = 0""",
)
