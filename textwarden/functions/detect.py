"""Detection as plain Spark expressions.

``hit_flags`` is the only place where built-in and shared custom rules run over the
text: one boolean per rule, in one pass, without shuffle or join.  What follows
(labels, scores, spans) reads ``matched``, a short array per text.

``text`` is a SQL expression here, most often a column name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.rules import Rule, builtin_rules
from textwarden.functions.sqltext import all_of, any_of, computed_once, ident, lit

MATCHED_TYPE = (
    "array<struct<ord:int,id:string,label:string,risk:double,critical:boolean,regex:string>>"
)


def needle_gate(text: str, rule: Rule) -> str | None:
    """Test for literal text the rule cannot do without, or None when there is none."""
    groups = [any_of(f"contains({text}, {lit(n)})" for n in group) for group in rule.needles]
    return all_of(groups) if groups else None


def cheap_tests(text: str, rule: Rule) -> list[str]:
    """Tests on the text itself that pass wherever the rule hits, but for its needles."""
    tests = [
        any_of(f"contains(lower({text}), {lit(n)})" for n in group) for group in rule.folded_needles
    ]
    if rule.probe:
        tests.append(f"rlike({text}, {lit(rule.probe)})")
    if not tests and not rule.needles and rule.derived_needle:
        needle, folded = rule.derived_needle
        tests.append(f"contains({f'lower({text})' if folded else text}, {lit(needle)})")
    return tests


def hit(text: str, rule: Rule) -> str:
    """Test whether the rule hits the text; cheap necessary tests come first."""
    gate = needle_gate(text, rule)
    tests = ([gate] if gate else []) + cheap_tests(text, rule)
    if not rule.probe_is_exact:
        tests.append(f"rlike({text}, {lit(rule.detector())})")
    return f"coalesce({all_of(tests)}, false)"


def any_hit(text: str = "text", rules: Sequence[Rule] | None = None) -> str:
    """Test whether any rule hits; stops at the first that does."""
    return any_of(hit(text, r) for r in (builtin_rules() if rules is None else rules))


def hit_flags(text: str = "text", rules: Sequence[Rule] | None = None) -> str:
    """One boolean per rule, in rule order."""
    flags = ", ".join(hit(text, r) for r in (builtin_rules() if rules is None else rules))
    return f"cast(array({flags}) AS array<boolean>)"


_ENTRY = "struct<ord:int,id:string,label:string,risk:double,critical:boolean,regex:string>"


def _entry(rule: Rule) -> str:
    return (
        f"named_struct('ord', {rule.ord}, 'id', {lit(rule.id)}, 'label', {lit(rule.label)}, "
        f"'risk', double({float(rule.risk)!r}), 'critical', {str(rule.critical).lower()}, "
        f"'regex', {lit(rule.detector())})"
    )


def matched_rules(flags: str, rules: Sequence[Rule] | None = None) -> str:
    """The rules whose flag is set, as an array of structs in rule order."""
    entries = ", ".join(
        f"if({flags}[{i}], {_entry(r)}, NULL)" for i, r in enumerate(builtin_rules() if rules is None else rules)
    )
    return f"array_compact(array({entries}))" if entries else f"cast(array() AS array<{_ENTRY}>)"


def with_matched(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    out: str = "matched",
    only_found: bool = False,
) -> DataFrame:
    """Adds the array of matched rules; ``only_found`` drops texts no rule hits."""
    flagged = computed_once(df, _flags=hit_flags(ident(text), rules))
    if only_found:
        flagged = flagged.filter(F.array_contains("_flags", True))
    return flagged.select(*df.columns, F.expr(matched_rules("_flags", rules)).alias(out))


def labels(matched: Column) -> Column:
    """Labels of the matched rules; equal labels of two rules both stay."""
    return matched["label"]


def finding_count(matched: Column) -> Column:
    return F.size(matched)


def has_findings(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """Adds ``has_findings``."""
    return computed_once(df, has_findings=any_hit(ident(text), rules))


def occurrences(text: str, rule: Rule) -> str:
    """How often the rule hits."""
    return f"if({hit(text, rule)}, regexp_count({text}, {lit(rule.detector())}), 0)"


def finding_occurrences(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text"
) -> DataFrame:
    """One row per unit and rule that hits, with the number of hits; the text is dropped."""
    kept = [c for c in df.columns if c != text]
    counts = ", ".join(
        f"named_struct('rule_id', {lit(r.id)}, 'label', {lit(r.label)}, "
        f"'occurrences', {occurrences(ident(text), r)})"
        for r in (builtin_rules() if rules is None else rules)
    )
    if not counts:
        counts = "named_struct('rule_id', '', 'label', '', 'occurrences', 0)"
    rows = df.select(*kept, F.expr(f"inline(array({counts}))"))
    return rows.filter("occurrences > 0")


def detect_labels(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text"
) -> DataFrame:
    """Adds ``findings``: the labels found in the text, in rule order."""
    scanned = with_matched(df, rules, text)
    return scanned.select(*df.columns, labels(F.col("matched")).alias("findings"))
