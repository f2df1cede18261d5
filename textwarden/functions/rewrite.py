"""Ordered rewriting of text with placeholders.

Each rule rewrites the output of the one before, so the chain is never reordered
or merged.  A step is skipped where cheap tests show that its rule cannot hit:

* Probes, and literals read off a user rule's regex, are tested on the running text, and
  are found wherever the rule hits.
* Needles of built-in rules are tested on the *original* text.  Every rewrite by a
  built-in rule puts in ``<NAME>``, needles hold neither ``<`` nor ``>`` and occur in
  no placeholder, so a needle in the running text is a needle of the original.

``text`` is a SQL expression here, most often a column name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detect import cheap_tests, needle_gate
from textwarden.functions.rules import BUILTIN_COUNT, Rule, builtin_rules
from textwarden.functions.sqltext import all_of, computed_once, ident, lit


def rewrite_once(text: str, rule: Rule) -> str:
    """All hits of one rule replaced."""
    pattern, replacement = rule.rewriter()
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)})"


def _step(original: str, rule: Rule, gated: bool) -> str:
    """The rule applied to the running text ``t``, skipped where it cannot hit."""
    tests = [needle_gate(original, rule)] if gated and rule.needles else []
    tests += cheap_tests("t", rule)
    done = rewrite_once("t", rule)
    return f"if({all_of(tests)}, {done}, t)" if tests else done


def rewrite_chain(text: str = "text", rules: Sequence[Rule] | None = None) -> str:
    """Every rule applied in order.

    A step reads the running text more than once, to test and to rewrite it.  Binding
    it with ``transform`` keeps the expression as long as the list of rules; written
    out, every step would double it.
    """
    out, leading = text, True
    for rule in builtin_rules() if rules is None else rules:
        leading = leading and rule.ord < BUILTIN_COUNT
        out = f"get(transform(array({out}), t -> {_step(text, rule, leading)}), 0)"
    return out


def sanitize(
    text: str = "text", rules: Sequence[Rule] | None = None, found: str | None = None
) -> str:
    """The text with every finding replaced.

    ``found``, a test whether any rule hits, saves the steps where it is already known:
    a text no rule hits stays as it is, since by induction every step is the identity.
    """
    chain = rewrite_chain(text, rules)
    return f"if({found}, {chain}, {text})" if found else chain


def changed(text: Column, sanitized: Column) -> Column:
    return ~text.eqNullSafe(sanitized)


def sanitize_range(
    df: DataFrame,
    start: Column,
    end: Column,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    out: str = "sanitized",
) -> DataFrame:
    """Rewrites characters ``[start, end)`` only; the rules see nothing but that slice."""
    whole = F.col(text)
    cut = df.select(
        "*",
        F.substring(whole, F.lit(1), start).alias("_head"),
        F.substring(whole, start + 1, end - start).alias("_body"),
        F.substring(whole, end + 1, F.length(whole)).alias("_tail"),
    )
    done = computed_once(cut, _clean=sanitize("_body", rules))
    return done.select(*df.columns, F.concat("_head", "_clean", "_tail").alias(out))


def replace_span(text: Column, start: Column, end: Column, placeholder: Column) -> Column:
    """Characters ``[start, end)`` replaced by the placeholder, or the text if there is none."""
    head = F.substring(text, F.lit(1), start)
    tail = F.substring(text, end + 1, F.length(text))
    return F.coalesce(F.concat(head, placeholder, tail), text)


def sanitize_corpus(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    excluded: Column | None = None,
) -> DataFrame:
    """Adds ``sanitized`` and ``changed``; excluded units pass through, no size limit applies."""
    kept, scanned = df.columns, None
    if excluded is not None:
        df = df.select("*", F.coalesce(excluded, F.lit(False)).alias("_excluded"))
        scanned = "NOT _excluded"
    out = computed_once(df, sanitized=sanitize(ident(text), rules, scanned))
    return out.select(*kept, "sanitized", changed(F.col(text), F.col("sanitized")).alias("changed"))
