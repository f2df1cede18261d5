"""Registered queries: user rules read from files, compiled, and used for scanning.

The rule files are derived from ``benchmark``: every item stands for a repository and
asks for the first two words of its text, among entries that are malformed, disabled or
not valid.  Documents hold passages of those texts, so the rules find something.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import dialect
from textwarden.functions.risk import score_matched, score_units
from textwarden.functions.rewrite import sanitize_corpus
from textwarden.functions.rules import BUILTIN_COUNT, Rule, builtin_rules
from textwarden.operators.custom_rules import (
    collect_rules, compile_rules, find_rules, match_repo_rules, numbered, rule_errors, sanitize_matched,
    warn_once,
)
from textwarden.operators.shared_rules import SENT_BYTES, match_shared_rules
from textwarden.operators.spans import detect_spans
from textwarden.operators.staging import shared_folder
from textwarden.plans import sql
from textwarden.plans.fixtures import PLANTED_SQL, documents, planted, quoted
from textwarden.plans.registry import Query
from textwarden.sources.corpus import scan_corpus
from textwarden.sources.rule_files import load_rule_files, merge_rule_sources, parse_rule_files

QUERIES: dict[str, Query] = {}

REPOS = 50
_SPACE_RE2 = f"[{dialect.space_class(dialect.RE2)}]"

# One rule file per benchmark item, as SQL both engines run.  Two of seven files are
# not usable at all.
_WORDS = (
    "regexp_extract(text, '([A-Za-z]{{2,}})[^A-Za-z]+([A-Za-z]{{2,}})', {n})"
)
_FILE = (
    "CASE item_id % 7 WHEN 3 THEN text WHEN 5 THEN '{{\"patterns\": \"none\"}}' ELSE "
    "concat('{{\"patterns\": [', "
    "'{{\"id\": \"words\", \"label\": \"Words of ', item_id, '\", \"regex\": \"{b}b', w1, '{b}s+', w2, "
    "'{b}b\", \"flags\": \"', CASE WHEN item_id % 3 = 0 THEN 'i' ELSE 'g' END, "
    "'\", \"riskScore\": ', item_id * 7 - 20, ', \"critical\": ', "
    "CASE WHEN item_id % 5 = 0 THEN 'true' ELSE 'false' END, '}}, ', "
    "'{{\"id\": ', item_id, ', \"label\": \"numeric id\", \"regex\": \"x\"}}, null, \"text\", ', "
    "'{{\"id\": \"off\", \"label\": \"Off\", \"regex\": \"the\", \"enabled\": false}}, ', "
    "'{{\"id\": \"bad\", \"label\": \"Bad\", \"regex\": \"[bad((', item_id % 4, '\"}}, ', "
    "'{{\"id\": \"words\", \"label\": \"First of ', item_id, '\", \"regex\": \"{b}b', w1, "
    "'{b}b\", \"placeholder\": \"[$&]cost$\", \"riskScore\": ', item_id % 10, '.5}}', "
    "']}}') END"
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr(
        "item_id", "text", f"{_WORDS.format(n=1)} AS w1", f"{_WORDS.format(n=2)} AS w2"
    )
    content = _FILE.format(b="\\\\\\\\")
    return items.selectExpr(
        "string(item_id) AS repo_id", "lpad(string(item_id), 9, '0') AS folder", f"{content} AS content"
    )


_FILES_SQL = (
    "SELECT CAST(item_id AS VARCHAR) AS repo_id, lpad(CAST(item_id AS VARCHAR), 9, '0') AS folder, "
    "item_id, w1, w2, " + _FILE.format(b="\\\\") + " AS content FROM (SELECT item_id, text, "
    + _WORDS.format(n=1) + " AS w1, " + _WORDS.format(n=2) + " AS w2 FROM benchmark) b"
)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rule_files(_files(spark, sf_dir))


def _parse(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "repo_id", "folder", F.col("pos").cast("bigint").alias("pos"), "id", "label", "regex",
        "flags", "placeholder", "risk_score",
        *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("critical", "enabled")],
    )


_RAW_SQL = f"""
    WITH files AS ({_FILES_SQL}),
    lists AS (SELECT repo_id, folder, json_extract(content, '$.patterns[*]') AS entries
      FROM files WHERE json_valid(content)),
    entries AS (SELECT repo_id, folder, unnest(entries) AS e,
      unnest(range(0, len(entries))) AS pos FROM lists),
    raw AS (SELECT repo_id, folder, CAST(pos AS BIGINT) AS pos, e->>'$.id' AS id,
      e->>'$.label' AS label, e->>'$.regex' AS regex, e->>'$.flags' AS flags,
      e->>'$.placeholder' AS placeholder, CAST(e->>'$.riskScore' AS DOUBLE) AS risk_score,
      CAST(e->>'$.critical' AS BOOLEAN) AS critical, CAST(e->>'$.enabled' AS BOOLEAN) AS enabled
      FROM entries WHERE json_type(e, '$.id') = 'VARCHAR' AND json_type(e, '$.label') = 'VARCHAR'
      AND json_type(e, '$.regex') = 'VARCHAR')"""

QUERIES["parse_rule_files"] = Query(
    _parse,
    _RAW_SQL + " SELECT * REPLACE (coalesce(CAST(critical AS VARCHAR), '-') AS critical, "
    "coalesce(CAST(enabled AS VARCHAR), '-') AS enabled) FROM raw",
)


def _merged(spark, sf_dir):
    """File rules before personal ones; each file's second half is used as settings too."""
    raw = _raw(spark, sf_dir)
    merged = merge_rule_sources(raw, raw.filter("id = 'words'"))
    return merged.groupBy("source_rank", "id").agg(F.count("*").alias("definitions")).select(
        F.col("source_rank").cast("bigint").alias("source_rank"), "id", "definitions"
    )


QUERIES["merge_rule_sources"] = Query(
    _merged,
    _RAW_SQL + " SELECT CAST(0 AS BIGINT) AS source_rank, id, count(*) AS definitions FROM raw "
    "GROUP BY id UNION ALL SELECT 1, id, count(*) FROM raw WHERE id = 'words' GROUP BY id",
)

# The usable rules in SQL: the two regexes are known, so they are written for RE2 here.
_RULES_SQL = _RAW_SQL + f""",
    usable AS (SELECT raw.repo_id, raw.folder, raw.pos, id, label,
      greatest(0, least(100, coalesce(risk_score, 0))) AS risk, coalesce(critical, false) AS critical,
      coalesce(placeholder, '<REDACTED>') AS placeholder,
      CASE WHEN placeholder IS NULL THEN '<REDACTED>' ELSE '[\\0]cost$' END AS replacement,
      CASE WHEN raw.flags = 'i' THEN '(?i)' ELSE '' END || '\\b' || w1 ||
      CASE WHEN raw.regex LIKE '%+%' THEN {quoted(_SPACE_RE2 + '+')} || w2 ELSE '' END || '\\b' AS re2
      FROM raw JOIN files f ON raw.repo_id = f.repo_id
      WHERE coalesce(enabled, true) AND id <> 'bad'),
    placed AS (SELECT raw.repo_id, raw.folder, raw.pos,
      {BUILTIN_COUNT - 1} + row_number() OVER (PARTITION BY raw.repo_id ORDER BY raw.pos) AS ord,
      {BUILTIN_COUNT - 1} + row_number() OVER (ORDER BY raw.folder, raw.pos) AS shared_ord FROM raw)"""


def _compiled(spark, sf_dir):
    return compile_rules(_raw(spark, sf_dir)).select(
        "repo_id", F.col("ord").cast("bigint").alias("ord"), "id", "label", "placeholder", "risk",
        "critical",
    )


QUERIES["custom_rules"] = Query(
    _compiled,
    _RULES_SQL + " SELECT u.repo_id, CAST(p.ord AS BIGINT) AS ord, id, label, placeholder, "
    "risk, critical FROM usable u JOIN placed p ON u.repo_id = p.repo_id AND u.pos = p.pos",
)
QUERIES["rule_errors"] = Query(
    lambda spark, sf_dir: rule_errors(_raw(spark, sf_dir)).select("repo_id", "id", "message"),
    _RAW_SQL + " SELECT repo_id, id, 'ignoring custom pattern \"' || id || '\" — invalid regex: ' "
    "|| regex AS message FROM raw WHERE id = 'bad'",
)
QUERIES["warn_once"] = Query(
    lambda spark, sf_dir: warn_once(rule_errors(_raw(spark, sf_dir))),
    _RAW_SQL + " SELECT DISTINCT 'ignoring custom pattern \"' || id || '\" — invalid regex: ' "
    "|| regex AS message FROM raw WHERE id = 'bad'",
)


def _find(spark, sf_dir):
    rules = compile_rules(_raw(spark, sf_dir), max_custom=None).withColumn(
        "id", F.concat_ws("/", "repo_id", "id")
    )
    return find_rules(rules).select("id", "label", F.col("ord").cast("bigint").alias("ord"))


QUERIES["find_rule"] = Query(
    _find,
    _RULES_SQL + " SELECT u.repo_id || '/' || id AS id, arg_min(label, p.ord) AS label, "
    "CAST(min(p.ord) AS BIGINT) AS ord FROM usable u JOIN placed p "
    "ON u.repo_id = p.repo_id AND u.pos = p.pos GROUP BY 1",
)


def _shared(max_custom):
    def run(spark, sf_dir):
        rules = collect_rules(compile_rules(_raw(spark, sf_dir), max_custom, key=None))
        units = planted(spark, sf_dir).select("doc_id", "path", "text")
        rows = score_units(units, rules, path="path")
        return rows.select(
            "doc_id", F.col("score").cast("double").alias("score"), "level",
            F.array_join("findings", ", ").alias("findings"),
        )

    return run


def _scored_with(custom: str) -> str:
    """CTEs for scores of ``units`` under built-in rules plus the hits in ``custom``."""
    bonus = "CASE WHEN n >= 2 THEN 20 ELSE 0 END + CASE WHEN n >= 4 THEN 15 ELSE 0 END"
    return f""",
    rules AS ({sql.rules_values()}), hits AS ({sql.hits('units')}),
    all_hits AS (SELECT doc_id, hits.ord, label, risk, critical FROM hits JOIN rules
      ON hits.ord = rules.ord UNION ALL {custom}),
    sums AS (SELECT u.doc_id, u.path, u.text, count(h.ord) AS n, coalesce(sum(risk), 0) AS base,
      coalesce(bool_or(critical), false) AS crit,
      coalesce(string_agg(label, ', ' ORDER BY h.ord), '') AS findings
      FROM units u LEFT JOIN all_hits h ON u.doc_id = h.doc_id GROUP BY u.doc_id, u.path, u.text),
    risk AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN crit THEN greatest(base, 60) ELSE base END
      + {sql.path_modifier()} + {bonus})) AS DOUBLE) AS score FROM sums)
    SELECT doc_id, score, {sql.level('score')} AS level, findings FROM risk"""


def _shared_sql(limit: str) -> str:
    return _RULES_SQL + f", units AS ({PLANTED_SQL})" + _scored_with(
        "SELECT d.doc_id, p.shared_ord, label, risk, critical FROM units d, usable u JOIN placed p "
        f"ON u.repo_id = p.repo_id AND u.pos = p.pos WHERE {limit} AND regexp_matches(d.text, u.re2)"
    )


QUERIES["custom_rules_capped"] = Query(
    _shared(50), _shared_sql(f"p.shared_ord < {BUILTIN_COUNT + 50}")
)



def _uncapped(spark, sf_dir):
    """All definitions of all files as one set, whatever their number."""
    rules = compile_rules(_raw(spark, sf_dir), max_custom=None, key=None)
    units = planted(spark, sf_dir).select("doc_id", "path", "text")
    matched = match_shared_rules(units, rules, max_sent=SENT_BYTES)
    rows = score_matched(matched, path="path", whole=False)
    return rows.select("doc_id", "score", "level", F.array_join("findings", ", ").alias("findings"))


QUERIES["custom_rules_uncapped"] = Query(_uncapped, _shared_sql("true"))


def _written_files(spark, sf_dir):
    """The rule files as files, one to a folder, read back; two files of a hundred are damaged on the way."""
    folder = os.path.join(shared_folder(spark), f"rule-files-{uuid.uuid4().hex}")
    files = _files(spark, sf_dir).withColumn("content", F.when(F.col("folder") % 50 == 1, F.lit('{"patterns": [{')).otherwise(F.col("content")))
    # Spark names the files it writes, so the pattern takes them all.
    files.select("folder", "content").repartition("folder").write.partitionBy("folder").option("lineSep", "\n").text(folder)
    return load_rule_files(spark, folder, file_name="*.txt")


def _loaded(spark, sf_dir):
    raw = parse_rule_files(_written_files(spark, sf_dir))
    name = F.regexp_extract("folder", r"folder=([0-9]+)\z", 1).cast("bigint").alias("folder")
    return raw.select(name, F.col("pos").cast("bigint").alias("pos"), "id", "label", "regex")


QUERIES["load_rule_files"] = Query(
    _loaded,
    _RAW_SQL + " SELECT CAST(folder AS BIGINT) AS folder, pos, id, label, regex FROM raw WHERE CAST(folder AS BIGINT) % 50 <> 1",
)


def _merged_order(spark, sf_dir):
    """Every definition with its place in the order of the merged sources."""
    raw = _raw(spark, sf_dir)
    placed = numbered(merge_rule_sources(raw, raw.filter("id = 'words'")), max_custom=None, key=None)
    return placed.select(F.col("ord").cast("bigint").alias("ord"), F.col("source_rank").cast("bigint").alias("source_rank"), "folder", "id", "label")


QUERIES["rule_order"] = Query(
    _merged_order,
    _RAW_SQL + f", merged AS (SELECT 0 AS source_rank, * FROM raw UNION ALL SELECT 1, * FROM raw WHERE id = 'words') "
    f"SELECT {BUILTIN_COUNT - 1} + row_number() OVER (ORDER BY source_rank, folder, pos) AS ord, "
    "CAST(source_rank AS BIGINT) AS source_rank, folder, id, label FROM merged",
)

# A rule that may hit nothing: its hits count up to the first empty one, which ends its scan.
_MAY_BE_EMPTY = r"the |(?=[^t])"


def _zero_length(spark, sf_dir):
    """The hits at the start of a text, which an empty one at the first other word cuts off."""
    rule = Rule(BUILTIN_COUNT, "article", "Article", _MAY_BE_EMPTY)
    # Every document starts with none to six articles; later ones must not be found.
    units = documents(spark, sf_dir).select(
        "doc_id", F.expr("concat(repeat('the ', int(doc_id % 7)), 'or the ', text)").alias("text")
    )
    spans = detect_spans(units, (rule,))
    return spans.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("fin"))


QUERIES["zero_length_hits"] = Query(
    _zero_length,
    "SELECT doc_id, CAST(4 * i AS BIGINT) AS start, CAST(4 * i + 4 AS BIGINT) AS fin "
    "FROM (SELECT doc_id, unnest(range(0, doc_id % 7)) AS i FROM documents) t",
)

_REPO_SQL = f"SELECT *, CAST(doc_id % {REPOS} AS VARCHAR) AS repo_id FROM ({PLANTED_SQL}) p"


def _repo_units(spark, sf_dir):
    repo = F.pmod("doc_id", F.lit(REPOS)).cast("string").alias("repo_id")
    return planted(spark, sf_dir).select("doc_id", repo, "path", "text")


def _per_repo(spark, sf_dir):
    rules = compile_rules(_raw(spark, sf_dir), max_custom=None)
    matched = match_repo_rules(_repo_units(spark, sf_dir), rules)
    rows = score_matched(matched, path="path", whole=False)
    return rows.select("doc_id", "score", "level", F.array_join("findings", ", ").alias("findings"))


QUERIES["rules_per_repo"] = Query(
    _per_repo,
    _RULES_SQL + f", units AS ({_REPO_SQL})" + _scored_with(
        "SELECT d.doc_id, p.ord, label, risk, critical FROM units d "
        "JOIN usable u ON d.repo_id = u.repo_id JOIN placed p ON u.repo_id = p.repo_id "
        "AND u.pos = p.pos WHERE regexp_matches(d.text, u.re2)"
    ),
)


def _per_repo_clean(spark, sf_dir):
    rules = compile_rules(_raw(spark, sf_dir), max_custom=None)
    done = sanitize_matched(match_repo_rules(_repo_units(spark, sf_dir), rules))
    return done.select("doc_id", F.md5("sanitized").alias("sanitized_md5"))


QUERIES["sanitize_per_repo"] = Query(
    _per_repo_clean,
    _RULES_SQL + f""", units AS ({_REPO_SQL}),
    pairs AS (SELECT repo_id, max(CASE WHEN regex_no = 1 THEN re2 END) AS r1,
      max(CASE WHEN regex_no = 2 THEN re2 END) AS r2 FROM (SELECT repo_id, re2,
      row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS regex_no FROM usable) t GROUP BY repo_id),
    built AS (SELECT d.doc_id, {sql.rewrite('d.text')} AS done, r1, r2 FROM units d
      LEFT JOIN pairs p ON d.repo_id = p.repo_id)
    SELECT doc_id, md5(CASE WHEN r1 IS NULL THEN done ELSE regexp_replace(regexp_replace(done, r1,
      '<REDACTED>', 'g'), r2, '[\\0]cost$', 'g') END) AS sanitized_md5 FROM built""",
)


def _per_repo_spans(spark, sf_dir):
    rules = compile_rules(_raw(spark, sf_dir), max_custom=None)
    matched = match_repo_rules(_repo_units(spark, sf_dir), rules).drop("repo_rules")
    rows = detect_spans(matched, matched="matched").filter(F.col("ord") >= BUILTIN_COUNT)
    return rows.groupBy("repo_id", "label").agg(
        F.count("*").alias("spans"), F.sum("start").alias("start_sum")
    )


QUERIES["spans_per_repo"] = Query(
    _per_repo_spans,
    _RULES_SQL + f""", units AS ({_REPO_SQL}),
    pieces AS (SELECT d.repo_id, label, regexp_extract_all(d.text, u.re2, 0) AS m,
      string_split_regex(d.text, u.re2) AS g FROM units d JOIN usable u ON d.repo_id = u.repo_id),
    numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces)
    SELECT repo_id, label, count(*) AS spans, CAST(sum(
      list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) AS BIGINT) AS start_sum
    FROM numbered GROUP BY repo_id, label""",
)
