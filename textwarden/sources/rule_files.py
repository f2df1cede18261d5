"""User rules from JSON files: one file per repository, read and checked as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.sqltext import lit

#: Order of sources: repository files come before personal settings.
REPO_RANK, SETTINGS_RANK = 0, 1
DEFAULT_FILE_NAME = "textwarden.json"

RAW_COLUMNS = (
    "repo_id", "source_rank", "folder", "pos", "id", "label", "regex", "flags", "placeholder",
    "risk_score", "critical", "enabled",
)


def load_rule_files(
    spark: SparkSession, path: str, file_name: str = DEFAULT_FILE_NAME, skip_damaged: bool = False
) -> DataFrame:
    """``(repo_id, folder, content)`` of every rule file below ``path``.

    The folder that holds the file names the repository.  Spark lists no files whose name
    starts with a dot, so neither may these.  A repository without a file
    simply has no row, hence no rules.  A file that cannot be read fails the job, unless
    ``skip_damaged`` leaves it, and its rules, out.
    """
    files = (
        spark.read.option("ignoreMissingFiles", skip_damaged)
        .option("ignoreCorruptFiles", skip_damaged)
        .text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=file_name)
    )
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*\z", "")
    return files.select(
        folder.alias("repo_id"), folder.alias("folder"), F.col("value").alias("content")
    )


def _kind(field: str) -> str:
    return f"coalesce(schema_of_variant(variant_get(entry, {lit('$.' + field)}, 'variant')), '')"


def _text(field: str) -> str:
    return f"if({_kind(field)} = 'STRING', try_variant_get(entry, {lit('$.' + field)}, 'string'), NULL)"


def _truth(field: str) -> str:
    """A JSON value read as a condition: empty text, zero and null are false."""
    path = lit("$." + field)
    kind = _kind(field)
    return (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN try_variant_get(entry, {path}, 'boolean') "
        f"WHEN {kind} = 'STRING' THEN length(try_variant_get(entry, {path}, 'string')) > 0 "
        f"WHEN {kind} IN ('', 'VOID') THEN NULL "
        f"ELSE coalesce(try_variant_get(entry, {path}, 'double') <> 0, true) END"
    )


def parse_rule_files(files: DataFrame, source_rank: int = REPO_RANK) -> DataFrame:
    """The well-formed entries of the files, one row each, in file order.

    Each entry is checked by itself: one bad entry costs no other.  Text that is not
    JSON, or holds no list of patterns, yields no rows.
    """
    keys = [c for c in ("repo_id", "folder") if c in files.columns]
    entries = files.select(
        *keys,
        F.expr(
            "posexplode(try_variant_get(try_parse_json(content), '$.patterns', 'array<variant>'))"
        ).alias("pos", "entry"),
    )
    required = [
        f"{_kind(f)} = 'STRING' AND length(try_variant_get(entry, {lit('$.' + f)}, 'string')) > 0"
        for f in ("id", "label", "regex")
    ]
    kept = entries.filter(" AND ".join(required))
    fields = {
        "repo_id": "repo_id" if "repo_id" in keys else "string(NULL)",
        "source_rank": str(source_rank),
        "folder": "folder" if "folder" in keys else "string(NULL)",
        "pos": "pos",
        "id": _text("id"),
        "label": _text("label"),
        "regex": _text("regex"),
        "flags": _text("flags"),
        "placeholder": _text("placeholder"),
        "risk_score": "try_variant_get(entry, '$.riskScore', 'double')",
        "critical": _truth("critical"),
        "enabled": f"if({_kind('enabled')} = 'BOOLEAN', "
        "try_variant_get(entry, '$.enabled', 'boolean'), NULL)",
    }
    return kept.selectExpr(*[f"{fields[c]} AS {c}" for c in RAW_COLUMNS])


def merge_rule_sources(repo_rules: DataFrame, settings_rules: DataFrame) -> DataFrame:
    """Repository rules before settings rules.  Equal ids are all kept."""
    first = repo_rules.withColumn("source_rank", F.lit(REPO_RANK))
    return first.unionByName(settings_rules.withColumn("source_rank", F.lit(SETTINGS_RANK)))


def definition_order() -> list[Column]:
    """The order in which definitions are looked at."""
    return [F.col("source_rank"), F.col("folder"), F.col("pos")]
