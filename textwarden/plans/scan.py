"""Registered queries: detection, spans, rewriting, scores, gates and reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import dialect
from textwarden.functions.detect import (
    detect_labels, finding_occurrences, has_findings, with_matched,
)
from textwarden.functions.risk import (
    base_score, count_bonus, floored_score, path_context, path_modifier, risk_text, score_units,
)
from textwarden.functions.rewrite import sanitize, sanitize_corpus, sanitize_range
from textwarden.functions.rules import builtin_rules, rules_frame
from textwarden.operators.gate import (
    alerts, apply_actions, gate_report, gate_verdict, status_summary,
)
from textwarden.operators.spans import (
    detect_spans, diagnostics_rows, sanitize_first_span, sanitize_span, span_positions, utf16_offset,
)
from textwarden.operators.staging import shared_folder
from textwarden.operators.stats import (
    risk_pivot, risk_summary, rule_hit_cube, rule_hit_rollup, rule_hit_stats,
)
from textwarden.operators.sweep import sanitize_spans
from textwarden.plans import sql
from textwarden.plans.fixtures import (
    DOCUMENTS_SQL, PAGES_SQL, PLANTED_SQL, documents, pages, pick, pick_sql, planted, quoted,
)
from textwarden.plans.registry import Query
from textwarden.sources.corpus import (
    blank_gate, changed_only, exclude_globs, glob_regex, ignore_paths, is_excluded, scan_corpus, scan_files,
    size_gate, with_size_status, write_clean_copy,
)

QUERIES: dict[str, Query] = {}

_NEWLINE_RE2 = r"\r\n|\n|\r"


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _findings():
    return F.array_join("findings", ", ").alias("findings")


# -- detection -------------------------------------------------------------

def _detect(units):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect_labels(units(spark, sf_dir).select("doc_id", "text"))
        return found.select(
            "doc_id", F.size("findings").cast("bigint").alias("finding_count"), _findings()
        )

    return run


def _detect_sql(source: str) -> str:
    return f"""
    WITH units AS ({source}), rules AS ({sql.rules_values()}), hits AS ({sql.hits('units')})
    SELECT u.doc_id, count(h.ord) AS finding_count,
           coalesce(string_agg(r.label, ', ' ORDER BY r.ord), '') AS findings
    FROM units u LEFT JOIN hits h ON u.doc_id = h.doc_id LEFT JOIN rules r ON h.ord = r.ord
    GROUP BY u.doc_id"""


QUERIES["detect_labels"] = Query(_detect(documents), _detect_sql(DOCUMENTS_SQL))
QUERIES["detect_labels_planted"] = Query(_detect(planted), _detect_sql(PLANTED_SQL))
QUERIES["detect_labels_pages"] = Query(_detect(pages), _detect_sql(PAGES_SQL))


def _has_findings(spark, sf_dir):
    units = planted(spark, sf_dir).select("doc_id", "text")
    return has_findings(units).select("doc_id", "has_findings")


QUERIES["has_findings"] = Query(
    _has_findings,
    f"SELECT doc_id, {' OR '.join(sql.matches('text', r) for r in builtin_rules())} "
    f"AS has_findings FROM ({PLANTED_SQL}) u",
)


def _occurrences(spark, sf_dir):
    rows = finding_occurrences(planted(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "rule_id", *_big("occurrences"))


def _occurrences_sql(source: str) -> str:
    branches = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(r.id)} AS rule_id, CAST(len(regexp_extract_all(text, "
        f"{quoted(r.detector(dialect.RE2))}, 0)) AS BIGINT) AS occurrences FROM units"
        for r in builtin_rules()
    )
    return f"WITH units AS ({source}) SELECT * FROM ({branches}) t WHERE occurrences > 0"


QUERIES["finding_occurrences"] = Query(_occurrences, _occurrences_sql(PLANTED_SQL))

# -- spans -----------------------------------------------------------------

_SPAN_BRANCHES = " UNION ALL ".join(
    f"SELECT doc_id, {r.ord} AS ord, text, "
    f"regexp_extract_all(text, {quoted(r.detector(dialect.RE2))}, 0) AS m, "
    f"string_split_regex(text, {quoted(r.detector(dialect.RE2))}) AS g "
    f"FROM units WHERE {sql.matches('text', r)}"
    for r in builtin_rules()
)


def _spans_sql(source: str) -> str:
    """CTEs ending in ``spans``: the offsets are sums over the pieces before the hit."""
    return f"""
    WITH units AS ({source}), rules AS ({sql.rules_values()}), pieces AS ({_SPAN_BRANCHES}),
    numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces),
    offsets AS (
      SELECT doc_id, ord, text, m[i] AS hit,
             list_sum(list_transform(g[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start_at
      FROM numbered),
    spans AS (
      SELECT o.doc_id, CAST(o.ord AS BIGINT) AS ord, r.rule_id AS pattern_id, r.label,
             CAST(start_at AS BIGINT) AS start_at,
             CAST(start_at + length(hit) AS BIGINT) AS end_at, o.text, r.placeholder
      FROM offsets o JOIN rules r ON o.ord = r.ord)"""


def _spans(units):
    def run(spark, sf_dir):
        rows = detect_spans(units(spark, sf_dir).select("doc_id", "text"))
        return rows.select(
            "doc_id",
            "pattern_id",
            "label",
            F.col("ord").cast("bigint").alias("ord"),
            F.col("start").cast("bigint").alias("start_at"),
            F.col("end").cast("bigint").alias("end_at"),
        )

    return run


def _spans_query(source: str) -> str:
    return (
        _spans_sql(source)
        + " SELECT doc_id, pattern_id, label, ord, start_at, end_at FROM spans"
    )


QUERIES["detect_spans"] = Query(_spans(documents), _spans_query(DOCUMENTS_SQL))
QUERIES["detect_spans_planted"] = Query(_spans(planted), _spans_query(PLANTED_SQL))
QUERIES["detect_spans_pages"] = Query(_spans(pages), _spans_query(PAGES_SQL))


def _prefix_line(at: str) -> str:
    prefix = f"left(text, {at})"
    return f"CAST(len(regexp_extract_all({prefix}, '{_NEWLINE_RE2}', 0)) AS BIGINT)"


def _prefix_character(at: str) -> str:
    return f"CAST(length(regexp_extract(left(text, {at}), '[^\\n\\r]*$', 0)) AS BIGINT)"


def _positions(spark, sf_dir):
    rows = span_positions(planted(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", "pattern_id", F.col("start").cast("bigint").alias("start_at"),
        *_big("line", "character", "end_line", "end_character"),
    )


QUERIES["span_positions"] = Query(
    _positions,
    _spans_sql(PLANTED_SQL)
    + f""" SELECT doc_id, pattern_id, start_at,
      {_prefix_line('start_at')} AS line, {_prefix_character('start_at')} AS character,
      {_prefix_line('end_at')} AS end_line, {_prefix_character('end_at')} AS end_character
    FROM spans""",
)


def _utf16(spark, sf_dir):
    wide = detect_spans(
        planted(spark, sf_dir).select("doc_id", "text"), keep=("doc_id", "text")
    )
    return wide.select(
        "doc_id", "pattern_id", F.col("start").cast("bigint").alias("start_at"),
        utf16_offset(F.col("text"), F.col("start")).cast("bigint").alias("utf16_start"),
    )


QUERIES["span_utf16_offsets"] = Query(
    _utf16,
    _spans_sql(PLANTED_SQL)
    + r""" SELECT doc_id, pattern_id, start_at,
      start_at + len(regexp_extract_all(left(text, start_at), '[\x{10000}-\x{10ffff}]', 0))
        AS utf16_start
    FROM spans""",
)

GLOBS = ("/w/docs/**", "/w/*.tf", "**/.env", "/w/?.spec.ts")


def _diagnostics(spark, sf_dir):
    units = planted(spark, sf_dir).select("doc_id", "path", "text")
    rows = diagnostics_rows(units, globs=GLOBS)
    return rows.select(
        "doc_id", "path", "message", "severity", "code", "diagnostic_source",
        *_big("line", "character", "end_line", "end_character"),
    )


def _glob_sql(path: str = "path") -> str:
    tests = [
        f"regexp_matches(replace({path}, '\\', '/'), {quoted(glob_regex(g, target=dialect.RE2))})" for g in GLOBS
    ]
    return f"coalesce({' OR '.join(tests)}, false)"


QUERIES["diagnostics_rows"] = Query(
    _diagnostics,
    _spans_sql(f"SELECT * FROM ({PLANTED_SQL}) p WHERE strlen(text) <= 204800 AND NOT {_glob_sql()}")
    + f""" SELECT s.doc_id, u.path, 'Sensitive data detected: ' || s.label AS message,
      'Warning' AS severity, s.pattern_id AS code, 'textwarden' AS diagnostic_source,
      {_prefix_line('s.start_at').replace('text', 's.text')} AS line,
      {_prefix_character('s.start_at').replace('text', 's.text')} AS character,
      {_prefix_line('s.end_at').replace('text', 's.text')} AS end_line,
      {_prefix_character('s.end_at').replace('text', 's.text')} AS end_character
    FROM spans s JOIN units u ON s.doc_id = u.doc_id""",
)

# -- statistics ------------------------------------------------------------


def _stats(spark, sf_dir):
    units = planted(spark, sf_dir).select("source", "lang", "text")
    return rule_hit_stats(units, ("source", "lang")).select(
        "source", "lang", "rule_id", "label", *_big("units", "hits")
    )


_OCCURRENCE_CTE = f"""
    WITH units AS ({PLANTED_SQL}),
    counted AS (SELECT * FROM ({" UNION ALL ".join(
        f"SELECT source, lang, {quoted(r.id)} AS rule_id, {quoted(r.label)} AS label, "
        f"len(regexp_extract_all(text, {quoted(r.detector(dialect.RE2))}, 0)) AS n FROM units"
        for r in builtin_rules())}) t WHERE n > 0)"""

QUERIES["rule_hit_stats"] = Query(
    _stats,
    _OCCURRENCE_CTE
    + " SELECT source, lang, rule_id, label, count(*) AS units, CAST(sum(n) AS BIGINT) AS hits"
    " FROM counted GROUP BY ALL",
)


def _grouping(operator):
    def run(spark, sf_dir):
        units = planted(spark, sf_dir).select("source", "lang", "text")
        return operator(units).select(
            *[F.coalesce(c, F.lit("*")).alias(c) for c in ("source", "lang", "rule_id")],
            *_big("level_id", "unit_hits", "hits"),
        )

    return run


def _grouping_sql(kind: str) -> str:
    return (
        _OCCURRENCE_CTE
        + f""" SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang,
          coalesce(rule_id, '*') AS rule_id,
          CAST(grouping_id(source, lang, rule_id) AS BIGINT) AS level_id,
          count(*) AS unit_hits, CAST(sum(n) AS BIGINT) AS hits
        FROM counted GROUP BY {kind}(source, lang, rule_id)"""
    )


QUERIES["rule_hit_cube"] = Query(_grouping(rule_hit_cube), _grouping_sql("CUBE"))
QUERIES["rule_hit_rollup"] = Query(_grouping(rule_hit_rollup), _grouping_sql("ROLLUP"))

# -- rewriting -------------------------------------------------------------


def _sanitize(units):
    def run(spark, sf_dir):
        rows = sanitize_corpus(units(spark, sf_dir).select("doc_id", "text"))
        return rows.select("doc_id", "sanitized", "changed")

    return run


def _sanitize_sql(source: str) -> str:
    return (
        f"WITH units AS ({source}), done AS (SELECT doc_id, text, {sql.rewrite('text')} "
        "AS sanitized FROM units) SELECT doc_id, sanitized, text <> sanitized AS changed FROM done"
    )


QUERIES["sanitize_text"] = Query(_sanitize(documents), _sanitize_sql(DOCUMENTS_SQL))
QUERIES["sanitize_text_planted"] = Query(_sanitize(planted), _sanitize_sql(PLANTED_SQL))
QUERIES["sanitize_text_pages"] = Query(_sanitize(pages), _sanitize_sql(PAGES_SQL))


def _sanitize_excluded(spark, sf_dir):
    units = planted(spark, sf_dir).select("doc_id", "path", "text")
    rows = sanitize_corpus(units, excluded=is_excluded(F.col("path"), GLOBS))
    return rows.select("doc_id", "path", "sanitized", "changed")


QUERIES["sanitize_corpus"] = Query(
    _sanitize_excluded,
    f"WITH units AS ({PLANTED_SQL}), done AS (SELECT doc_id, path, text, "
    f"CASE WHEN {_glob_sql()} THEN text ELSE {sql.rewrite('text')} END AS sanitized FROM units) "
    "SELECT doc_id, path, sanitized, text <> sanitized AS changed FROM done",
)


def _changed(spark, sf_dir):
    rows = sanitize_corpus(planted(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.groupBy("source").agg(
        F.count("*").alias("units"), F.count_if("changed").alias("changed_units")
    )


QUERIES["changed_units"] = Query(
    _changed,
    f"WITH units AS ({PLANTED_SQL}) SELECT source, count(*) AS units, "
    f"CAST(count_if(text <> {sql.rewrite('text')}) AS BIGINT) AS changed_units "
    "FROM units GROUP BY source",
)


def _range(spark, sf_dir):
    length = F.length("text")
    units = planted(spark, sf_dir).select("doc_id", "text")
    done = sanitize_range(units, F.floor(length / 2).cast("int"), length)
    return done.select("doc_id", "sanitized")


QUERIES["sanitize_range"] = Query(
    _range,
    f"WITH units AS ({PLANTED_SQL}) SELECT doc_id, left(text, length(text) // 2) || "
    + sql.rewrite("substr(text, length(text) // 2 + 1)")
    + " AS sanitized FROM units",
)


def _first_span(spark, sf_dir):
    rows = sanitize_first_span(planted(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "pattern_id", "sanitized")


QUERIES["sanitize_first_span"] = Query(
    _first_span,
    _spans_sql(PLANTED_SQL)
    + """, first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, ord) AS n
      FROM spans)
    SELECT doc_id, pattern_id, left(text, start_at) || placeholder || substr(text, end_at + 1)
      AS sanitized FROM first WHERE n = 1""",
)


def _sanitize_each_span(spark, sf_dir):
    rows = detect_spans(planted(spark, sf_dir).select("doc_id", "text"), keep=("doc_id", "text"))
    done = sanitize_span(rows)
    return done.select(
        "doc_id", "pattern_id", F.col("start").cast("bigint").alias("start_at"),
        F.md5("sanitized").alias("sanitized_md5"),
    )


QUERIES["sanitize_span"] = Query(
    _sanitize_each_span,
    _spans_sql(PLANTED_SQL)
    + " SELECT doc_id, pattern_id, start_at, md5(left(text, start_at) || placeholder || "
    "substr(text, end_at + 1)) AS sanitized_md5 FROM spans",
)


def _sanitize_spans(spark, sf_dir):
    """Every text with findings once, all of its spans replaced in one sweep."""
    done = sanitize_spans(planted(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.md5("sanitized").alias("sanitized_md5"))


QUERIES["sanitize_spans"] = Query(
    _sanitize_spans,
    _spans_sql(PLANTED_SQL)
    + """, marked AS (
      SELECT *, coalesce(start_at >= max(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
      FROM spans WHERE start_at < end_at),
    grouped AS (
      SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY start_at, ord) AS n FROM marked),
    stretches AS (
      SELECT doc_id, n, any_value(text) AS text, min(start_at) AS low, max(end_at) AS high,
             max(placeholder) FILTER (fresh) AS placeholder
      FROM grouped GROUP BY doc_id, n),
    cut AS (
      SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY n), 0) AS behind FROM stretches)
    SELECT doc_id, md5(string_agg(substr(text, behind + 1, low - behind) || placeholder, '' ORDER BY n)
      || substr(any_value(text), max(high) + 1)) AS sanitized_md5 FROM cut GROUP BY doc_id""",
)

# -- scores ----------------------------------------------------------------


def _scores(units, path=None):
    def run(spark, sf_dir):
        kept = ["doc_id", "text"] + ([path] if path else [])
        rows = score_units(units(spark, sf_dir).select(*kept), path=path)
        return rows.select("doc_id", *_big("score", "finding_count"), "level", _findings())

    return run


def _scores_sql(source: str, path: str | None) -> str:
    return (
        f"WITH {sql.scored(source, path=path)} "
        "SELECT doc_id, score, finding_count, level, findings FROM risk"
    )


QUERIES["risk_score"] = Query(_scores(documents), _scores_sql(DOCUMENTS_SQL, None))
QUERIES["risk_score_pages"] = Query(_scores(pages), _scores_sql(PAGES_SQL, None))
QUERIES["risk_score_with_path"] = Query(_scores(planted, "path"), _scores_sql(PLANTED_SQL, "path"))


def _context(spark, sf_dir):
    return planted(spark, sf_dir).selectExpr(
        "doc_id", "path", f"coalesce({path_context()}, 'none') AS context",
        f"bigint({path_modifier()}) AS modifier",
    )


QUERIES["path_context"] = Query(
    _context,
    f"SELECT doc_id, path, coalesce({sql.path_context()}, 'none') AS context, "
    f"CAST({sql.path_modifier()} AS BIGINT) AS modifier FROM ({PLANTED_SQL}) u",
)

# Lines of test code, which two-of-eight content patterns look for.
_TEST_CODE = (
    "\ndescribe('a', () => {\n  it('b', () => {})\n})", "\nexpect(1)", "\njest.fn(); vitest.fn()",
    "\nimport x from '@testing-library/dom'\nx.should( )", "",
)
_TEST_FOLDERS = ("test/a.ts", "/a/test", "test", "/a/test_utils/test/a.ts", "/a/b.ts")


def _content_context(spark, sf_dir):
    units = documents(spark, sf_dir).select(
        "doc_id",
        pick(_TEST_FOLDERS, "doc_id").alias("path"),
        F.concat("text", pick(_TEST_CODE, f"doc_id div {len(_TEST_FOLDERS)}")).alias("text"),
    )
    rows = score_units(units, path="path")
    return rows.selectExpr(
        "doc_id", "path", "bigint(score) AS score", f"coalesce({path_context()}, 'none') AS context"
    )


_CONTENT_SQL = (
    f"SELECT doc_id, {pick_sql(_TEST_FOLDERS, 'doc_id')} AS path, text || "
    f"{pick_sql(_TEST_CODE, f'doc_id // {len(_TEST_FOLDERS)}')} AS text FROM documents"
)
QUERIES["test_file_by_content"] = Query(
    _content_context,
    f"WITH {sql.scored(_CONTENT_SQL)} SELECT doc_id, path, score, "
    f"coalesce({sql.path_context()}, 'none') AS context FROM risk",
)


def _summary(spark, sf_dir):
    scored = score_units(planted(spark, sf_dir), path="path")
    rows = risk_summary(scored, ("source",))
    return rows.select(
        "source", "level", *_big("units", "max_score"), F.round("mean_score", 6).alias("mean_score")
    )


QUERIES["risk_summary"] = Query(
    _summary,
    f"WITH {sql.scored(PLANTED_SQL)} SELECT source, level, count(*) AS units, "
    "max(score) AS max_score, round(avg(score), 6) AS mean_score FROM risk GROUP BY source, level",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per source and level over the documents as they are."""
    scored = score_units(documents(spark, sf_dir).select("source", "text"))
    rows = risk_summary(scored, ("source",))
    return rows.select(
        "source", "level", *_big("units", "max_score"), F.round("mean_score", 6).alias("mean_score")
    )


QUERIES["risk_summary_documents"] = Query(
    flagship,
    f"WITH {sql.scored(DOCUMENTS_SQL, path=None)} SELECT source, level, count(*) AS units, "
    "max(score) AS max_score, round(avg(score), 6) AS mean_score FROM risk GROUP BY source, level",
)


def _pivot(spark, sf_dir):
    scored = score_units(planted(spark, sf_dir), path="path")
    rows = risk_pivot(scored, ("lang", "source"))
    return rows.select(
        "lang", "source", *_big("low_units", "medium_units", "high_units", "units", "max_score")
    )


QUERIES["risk_pivot"] = Query(
    _pivot,
    f"WITH {sql.scored(PLANTED_SQL)} SELECT lang, source, "
    + ", ".join(
        f"CAST(count_if(level = '{x.upper()}') AS BIGINT) AS {x}_units" for x in ("low", "medium", "high")
    )
    + ", count(*) AS units, max(score) AS max_score FROM risk GROUP BY lang, source",
)


def _alerts(spark, sf_dir):
    rows = alerts(score_units(planted(spark, sf_dir).select("doc_id", "path", "text"), path="path"))
    return rows.select(
        "doc_id", "message", risk_text(F.col("score")).alias("risk_text")
    )


QUERIES["alerts"] = Query(
    _alerts,
    f"WITH {sql.scored(PLANTED_SQL)} SELECT doc_id, 'Risk ' || score || '/100 (' || level || ') — ' "
    "|| findings AS message, level || ' RISK' AS risk_text FROM risk WHERE level <> 'LOW'",
)


def _status(spark, sf_dir):
    units = planted(spark, sf_dir).select("doc_id", "path", "text")
    return status_summary(units).select("doc_id", "status", "tooltip", "colour")


QUERIES["status_summary"] = Query(
    _status,
    f"WITH {sql.scored(PLANTED_SQL)} SELECT doc_id, "
    "CASE WHEN strlen(text) > 204800 THEN 'File too large' ELSE level || ' (' || score || ')' END "
    "AS status, CASE WHEN strlen(text) > 204800 THEN 'File exceeds 200KB scanning limit' "
    "ELSE 'Sensitive data risk: ' || level || '. ' || finding_count || ' finding(s).' END AS tooltip, "
    "CASE WHEN strlen(text) > 204800 THEN NULL WHEN level = 'HIGH' THEN '#f14c4c' "
    "WHEN level = 'MEDIUM' THEN '#cca700' ELSE '#8dc891' END AS colour FROM risk",
)

# -- gates -----------------------------------------------------------------

# Change types met in a change feed; D and T bring no content to scan.
_ENLARGED_SQL = (
    "CASE WHEN doc_id % 40 = 7 THEN repeat(text, CAST(1 + 204800 // greatest(strlen(text), 1) AS BIGINT)) ELSE text END"
)
_CHANGE_TYPES = ("A", "C", "M", "R", "D", "T")
_CHANGES_SQL = (
    f"SELECT doc_id, source || '-' || (doc_id % 7) AS change_id, path, "
    f"{pick_sql(_CHANGE_TYPES, 'doc_id')} AS change_type, {_ENLARGED_SQL} AS text FROM ({PLANTED_SQL}) p"
)
_SCANNED_SQL = (
    "change_type IN ('A', 'C', 'M', 'R') AND coalesce(path, '') <> '' AND strlen(text) <= 204800"
)


def _changes(spark, sf_dir):
    units = planted(spark, sf_dir).withColumn("text", F.expr(
        "if(doc_id % 40 = 7, repeat(text, int(1 + 204800 div greatest(octet_length(text), 1))), text)"
    ))
    group = F.concat("source", F.lit("-"), F.pmod("doc_id", F.lit(7)).cast("string"))
    return units.select(
        "doc_id", group.alias("change_id"), "path",
        pick(_CHANGE_TYPES, "doc_id").alias("change_type"), "text",
    )


def _verdict(spark, sf_dir):
    rows = gate_verdict(_changes(spark, sf_dir))
    return rows.select("change_id", "verdict", *_big("offending_units", "skipped_units"))


_OFFENDS_SQL = f"({_SCANNED_SQL}) AND ({' OR '.join(sql.matches('text', r) for r in builtin_rules())})"
QUERIES["gate_verdict"] = Query(
    _verdict,
    f"WITH changes AS ({_CHANGES_SQL}), marked AS (SELECT change_id, {_OFFENDS_SQL} AS offends, "
    "change_type IN ('A', 'C', 'M', 'R') AND coalesce(path, '') <> '' AND strlen(text) > 204800 AS skipped "
    "FROM changes) SELECT change_id, CASE WHEN bool_or(offends) THEN 'block' ELSE 'pass' END "
    "AS verdict, CAST(count_if(offends) AS BIGINT) AS offending_units, "
    "CAST(count_if(skipped) AS BIGINT) AS skipped_units FROM marked GROUP BY change_id",
)


def _report(spark, sf_dir):
    rows = gate_report(_changes(spark, sf_dir))
    return rows.select("change_id", "doc_id", "report")


QUERIES["gate_report"] = Query(
    _report,
    f"WITH {sql.scored(f'SELECT * FROM ({_CHANGES_SQL}) c WHERE {_SCANNED_SQL}')} "
    "SELECT change_id, doc_id, path || ': ' || level || ' risk (score ' || score || ') — ' "
    "|| findings AS report FROM risk WHERE finding_count > 0",
)


def _changed_only(spark, sf_dir):
    return changed_only(_changes(spark, sf_dir)).select("doc_id", "path", "change_type")


QUERIES["changed_only"] = Query(
    _changed_only,
    f"SELECT doc_id, path, change_type FROM ({_CHANGES_SQL}) c "
    "WHERE change_type IN ('A', 'C', 'M', 'R') AND coalesce(path, '') <> ''",
)


def _size_gate(spark, sf_dir):
    kept = with_size_status(documents(spark, sf_dir).select("doc_id", "text"), 8192)
    return kept.select("doc_id", *_big("n_bytes"), "status")


QUERIES["size_status"] = Query(
    _size_gate,
    "SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) > 8192 THEN 'TOO_LARGE' "
    "ELSE 'OK' END AS status FROM documents",
)
QUERIES["size_gate"] = Query(
    lambda spark, sf_dir: size_gate(documents(spark, sf_dir), 8192).select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE strlen(text) <= 8192",
)

# Texts that are blank, some only in the wider sense of white space.
_BLANKS = ("", "  \n", "  ﻿", "x", None)


def _blank_gate(spark, sf_dir):
    units = documents(spark, sf_dir).select(
        "doc_id", F.coalesce(pick(_BLANKS, "doc_id"), F.col("text")).alias("text")
    )
    return blank_gate(units).select("doc_id", *[F.length("text").cast("bigint").alias("n_chars")])


QUERIES["blank_gate"] = Query(
    _blank_gate,
    f"WITH units AS (SELECT doc_id, coalesce({pick_sql(_BLANKS, 'doc_id')}, text) AS text "
    "FROM documents) SELECT doc_id, length(text) AS n_chars FROM units WHERE regexp_matches(text, "
    + quoted(f"[^{dialect.space_class(dialect.RE2)}]")
    + ")",
)
QUERIES["exclude_globs"] = Query(
    lambda spark, sf_dir: exclude_globs(planted(spark, sf_dir), GLOBS).select("doc_id", "path"),
    f"SELECT doc_id, path FROM ({PLANTED_SQL}) u WHERE NOT {_glob_sql()}",
)


def _ignored(spark, sf_dir):
    units = planted(spark, sf_dir).select("doc_id", F.col("lang").alias("owner"), "path")
    labels = scan_corpus(spark, f"{sf_dir}/labels.parquet", ("doc_id", "quality"))
    low = labels.filter("quality = 0").select("doc_id")
    ignored = units.join(low, "doc_id", "left_semi")
    return ignore_paths(units, ignored).select("doc_id", "owner", "path")


QUERIES["ignore_paths"] = Query(
    _ignored,
    f"WITH units AS (SELECT doc_id, lang AS owner, path FROM ({PLANTED_SQL}) p), "
    "ignored AS (SELECT DISTINCT owner, path FROM units WHERE doc_id IN "
    "(SELECT doc_id FROM labels WHERE quality = 0)) "
    "SELECT doc_id, owner, path FROM units u WHERE NOT EXISTS "
    "(SELECT 1 FROM ignored i WHERE i.owner = u.owner AND i.path = u.path)",
)


def _actions(spark, sf_dir):
    labels = scan_corpus(spark, f"{sf_dir}/labels.parquet", ("doc_id", "quality", "toxic"))
    action = F.when(F.col("toxic") == 1, "cancel").when(F.col("quality") == 1, "copy-sanitized")
    decisions = labels.select("doc_id", action.otherwise("copy-raw").alias("action"))
    units = planted(spark, sf_dir).select("doc_id", "text")
    return apply_actions(units, decisions).select(
        "doc_id", "action", F.md5("copied").alias("copied_md5")
    )


QUERIES["apply_actions"] = Query(
    _actions,
    f"""WITH units AS ({PLANTED_SQL}), found AS (
      SELECT doc_id, text, {' OR '.join(sql.matches('text', r) for r in builtin_rules())} AS hit FROM units),
    decided AS (SELECT f.doc_id, f.text, CASE WHEN NOT hit THEN 'copy-raw' WHEN l.doc_id IS NULL
      THEN 'cancel' WHEN l.toxic = 1 THEN 'cancel' WHEN l.quality = 1 THEN 'copy-sanitized'
      ELSE 'copy-raw' END AS action FROM found f LEFT JOIN labels l ON f.doc_id = l.doc_id)
    SELECT doc_id, action, md5(CASE WHEN action = 'copy-sanitized' THEN {sql.rewrite('text')}
      ELSE text END) AS copied_md5 FROM decided WHERE action <> 'cancel'""",
)


def _builtin(spark, sf_dir):
    """How many documents each built-in rule hits; rules without a hit show zero."""
    rules = rules_frame(spark)
    hits = rule_hit_stats(planted(spark, sf_dir).select("text"))
    return rules.join(hits.select(F.col("rule_id").alias("id"), "units"), "id", "left").select(
        F.col("ord").cast("bigint").alias("ord"), "id", "label", "placeholder", "risk", "critical",
        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"),
    )


QUERIES["builtin_rules"] = Query(
    _builtin,
    f"WITH units AS ({PLANTED_SQL}), rules AS ({sql.rules_values()}), hits AS ({sql.hits('units')}) "
    "SELECT CAST(r.ord AS BIGINT) AS ord, rule_id AS id, label, placeholder, risk, critical, "
    "count(h.doc_id) AS units FROM rules r LEFT JOIN hits h ON r.ord = h.ord GROUP BY ALL",
)


def _clean_copy(spark, sf_dir):
    """Writes the sanitized documents to the shared folder and reads them back."""
    folder = os.path.join(shared_folder(spark), f"clean-{uuid.uuid4().hex}")
    units = planted(spark, sf_dir).select("doc_id", "source", "text")
    write_clean_copy(sanitize_corpus(units), folder)
    copy = spark.read.parquet(folder)
    return copy.select("doc_id", "source", F.md5("text").alias("clean_md5"), "changed")


QUERIES["clean_copy"] = Query(
    _clean_copy,
    f"WITH units AS ({PLANTED_SQL}), done AS (SELECT doc_id, source, text, {sql.rewrite('text')} "
    "AS clean FROM units) SELECT doc_id, source, md5(clean) AS clean_md5, text <> clean AS changed FROM done",
)


def _risk_parts(spark, sf_dir):
    """The score taken apart: sum, floor, path, bonus."""
    found = with_matched(planted(spark, sf_dir).select("doc_id", "path", "text"))
    matched = F.col("matched")
    return found.select(
        "doc_id",
        base_score(matched).cast("bigint").alias("base"),
        floored_score(matched).cast("bigint").alias("floored"),
        F.expr(f"bigint({path_modifier()})").alias("modifier"),
        count_bonus(F.size(matched)).cast("bigint").alias("bonus"),
    )


QUERIES["risk_parts"] = Query(
    _risk_parts,
    f"""WITH units AS ({PLANTED_SQL}), rules AS ({sql.rules_values()}), hits AS ({sql.hits('units')}),
    sums AS (SELECT u.doc_id, count(r.ord) AS n, coalesce(sum(r.risk), 0) AS base,
      coalesce(bool_or(r.critical), false) AS critical FROM units u LEFT JOIN hits h
      ON u.doc_id = h.doc_id LEFT JOIN rules r ON h.ord = r.ord GROUP BY u.doc_id)
    SELECT u.doc_id, CAST(base AS BIGINT) AS base,
      CAST(CASE WHEN critical THEN greatest(base, 60) ELSE base END AS BIGINT) AS floored,
      CAST({sql.path_modifier('u.path', 'u.text')} AS BIGINT) AS modifier,
      CAST(CASE WHEN n >= 4 THEN 35 WHEN n >= 2 THEN 20 ELSE 0 END AS BIGINT) AS bonus
    FROM units u JOIN sums s ON u.doc_id = s.doc_id""",
)


def _scan_and_copy(spark, sf_dir):
    """Gate, scan, score and clean in one plan."""
    units = blank_gate(size_gate(planted(spark, sf_dir)))
    scored = score_units(units.select("doc_id", "path", "text"), path="path")
    return scored.select(
        "doc_id", *_big("score"), "level",
        F.expr(f"md5({sanitize(found='finding_count > 0')})").alias("clean_md5"),
    )


QUERIES["scan_and_copy"] = Query(
    _scan_and_copy,
    f"WITH {sql.scored(f'SELECT * FROM ({PLANTED_SQL}) p WHERE strlen(text) <= 204800')} "
    f"SELECT doc_id, score, level, md5({sql.rewrite('text')}) AS clean_md5 FROM risk",
)


# Files of fifty documents each; those above the limit are pruned by the listing, unread.
_FILE_DOCUMENTS, _FILE_BYTES = 50, 150_000


def _scanned_files(spark, sf_dir):
    """The documents written as text files, read back as units and scanned."""
    folder = os.path.join(shared_folder(spark), f"files-{uuid.uuid4().hex}")
    rows = documents(spark, sf_dir).select(
        F.expr(f"doc_id div {_FILE_DOCUMENTS}").alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text")
    sorted_rows.write.partitionBy("bucket").text(folder)
    files = scan_files(spark, folder, glob="*.txt", max_bytes=_FILE_BYTES)
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("bigint").alias("bucket")
    scored = score_units(files.select(bucket, "n_bytes", "text"))
    return scored.select("bucket", "n_bytes", F.md5("text").alias("text_md5"), F.col("score").cast("bigint").alias("score"), "level")


QUERIES["scan_files"] = Query(
    _scanned_files,
    "WITH "
    + sql.scored(
        f"SELECT * FROM (SELECT doc_id // {_FILE_DOCUMENTS} AS doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text "
        f"FROM documents GROUP BY 1) t WHERE strlen(text) <= {_FILE_BYTES}",
        path=None,
    )
    + " SELECT doc_id AS bucket, strlen(text) AS n_bytes, md5(text) AS text_md5, score, level FROM risk",
)
