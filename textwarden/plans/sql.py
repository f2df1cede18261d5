"""SQL twins of the rule expressions, for checking results in another engine."""

from __future__ import annotations

from collections.abc import Sequence

from textwarden.functions import dialect, risk
from textwarden.functions.rules import Rule, builtin_rules
from textwarden.plans.fixtures import quoted


def matches(column: str, rule: Rule) -> str:
    return f"regexp_matches({column}, {quoted(rule.detector(dialect.RE2))})"


def rules_values(rules: Sequence[Rule] | None = None) -> str:
    rows = ", ".join(
        f"({r.ord}, {quoted(r.id)}, {quoted(r.label)}, {quoted(r.placeholder)}, "
        f"{float(r.risk)!r}::DOUBLE, {str(r.critical).lower()}, {quoted(r.detector(dialect.RE2))})"
        for r in (builtin_rules() if rules is None else rules)
    )
    return (
        f"SELECT * FROM (VALUES {rows}) "
        "AS t(ord, rule_id, label, placeholder, risk, critical, regex)"
    )


def hits(source: str, key: str = "doc_id", rules: Sequence[Rule] | None = None) -> str:
    """Rows (key, ord) of the rules that hit the texts of ``source``."""
    flags = ", ".join(
        f"CASE WHEN {matches('text', r)} THEN {r.ord} END" for r in (builtin_rules() if rules is None else rules)
    )
    return (
        f"SELECT {key}, ord FROM (SELECT {key}, unnest([{flags}]) AS ord FROM {source}) "
        "WHERE ord IS NOT NULL"
    )


def rewrite(column: str, rules: Sequence[Rule] | None = None) -> str:
    """Every rule applied in order."""
    out = column
    for rule in builtin_rules() if rules is None else rules:
        pattern, replacement = rule.rewriter(dialect.RE2)
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return out


def _path_test(low: str, patterns: Sequence[str]) -> str:
    return f"regexp_matches({low}, {quoted(risk.one_of(patterns, dialect.RE2))})"


def path_context(path: str = "path", text: str = "text") -> str:
    normal = f"replace(coalesce({path}, ''), '\\', '/')"
    low = f"lower({normal})"
    votes = " + ".join(
        f"regexp_matches({text}, {quoted(dialect.translate(p, f, dialect.RE2).pattern)})::INT"
        for p, f in risk.TEST_CONTENT
    )
    test_file = (
        f"(NOT {_path_test(low, risk.NOT_TEST_PATHS)} AND ({_path_test(low, risk.TEST_PATHS)} "
        f"OR ({_path_test(low, (risk.TEST_DIRECTORY,))} "
        f"AND ({votes}) >= {risk.TEST_CONTENT_NEEDED})))"
    )
    return (
        f"CASE WHEN {_path_test(low, risk.TEMPLATE_PATHS)} THEN 'template' "
        f"WHEN NOT contains({normal}, '/test/') AND {test_file} THEN 'test' "
        f"WHEN NOT ends_with({normal}, 'README.md') "
        f"AND {_path_test(low, risk.DOCUMENTATION_PATHS)} THEN 'documentation' "
        f"WHEN {_path_test(low, risk.INFRASTRUCTURE_PATHS)} THEN 'infrastructure' END"
    )


def path_modifier(path: str = "path", text: str = "text") -> str:
    normal = f"replace(coalesce({path}, ''), '\\', '/')"
    by_context = " ".join(
        f"WHEN '{name}' THEN {value}"
        for name, value in zip(
            risk.CONTEXTS,
            (risk.TEMPLATE, risk.TEST_FILE, risk.DOCUMENTATION, risk.INFRASTRUCTURE),
        )
    )
    return (
        f"(CASE WHEN ends_with({normal}, '.env') THEN {risk.ENV_FILE} ELSE 0 END "
        f"+ CASE WHEN ends_with({normal}, 'README.md') THEN {risk.README_FILE} ELSE 0 END "
        f"+ CASE WHEN contains({normal}, '/test/') THEN {risk.TEST_FOLDER} ELSE 0 END "
        f"+ CASE {path_context(path, text)} {by_context} ELSE 0 END)"
    )


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} >= {risk.HIGH_FROM} THEN 'HIGH' "
        f"WHEN {score} >= {risk.MEDIUM_FROM} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def scored(
    source_sql: str,
    key: str = "doc_id",
    path: str | None = "path",
    rules: Sequence[Rule] | None = None,
    keep: str = "u.*",
) -> str:
    """CTEs ending in ``risk``: the units with score, level, findings, finding_count."""
    modifier = path_modifier(path) if path else "0"
    bonus = " + ".join(
        f"CASE WHEN coalesce(s.n, 0) >= {least} THEN {value} ELSE 0 END"
        for least, value in risk.MANY_FINDINGS
    )
    return f"""
    units AS ({source_sql}),
    rules AS ({rules_values(rules)}),
    hits AS ({hits('units', key, rules)}),
    sums AS (
      SELECT {key}, count(*) AS n, sum(risk) AS base, bool_or(critical) AS critical,
             string_agg(label, ', ' ORDER BY hits.ord) AS findings
      FROM hits JOIN rules ON hits.ord = rules.ord GROUP BY {key}),
    raw AS (
      SELECT {keep}, coalesce(s.n, 0) AS finding_count, coalesce(s.findings, '') AS findings,
             coalesce(CASE WHEN s.critical THEN greatest(s.base, {risk.CRITICAL_FLOOR}) ELSE s.base END, 0)
             + {modifier} + {bonus} AS points
      FROM units u LEFT JOIN sums s ON u.{key} = s.{key}),
    risk AS (
      SELECT * EXCLUDE (points), CAST(greatest(0, least(100, points)) AS BIGINT) AS score,
             {level('greatest(0, least(100, points))')} AS level
      FROM raw)"""
