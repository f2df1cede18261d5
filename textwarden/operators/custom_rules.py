"""User rules: compiling them, reporting what is wrong with them, scanning with them.

One rule set for all texts becomes literal expressions next to the built-in rules.
Rule sets that differ per repository stay data: they are joined to the texts, and the
regex functions take the pattern from the row.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.functions import dialect
from textwarden.functions.detect import hit_flags, matched_rules
from textwarden.functions.rewrite import rewrite_chain
from textwarden.functions.rules import (
    BUILTIN_COUNT, DEFAULT_PLACEHOLDER, MAX_CUSTOM_RULES, Rule, builtin_rules,
)
from textwarden.functions.sqltext import computed_once, ident
from textwarden.operators.staging import BROADCAST_BYTES, broadcast_if_small
from textwarden.sources.rule_files import definition_order

# Python workers need the translator; they may not have this package installed.
cloudpickle.register_pickle_by_value(dialect)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: More rules than this are not unrolled into one expression; join them instead.
MAX_LITERAL_RULES = 500


_COMPILED = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("java_regex", "replacement", "needle", "literal", "error")
    ]
)


@F.pandas_udf(_COMPILED)
def _compiled(regex: pd.Series, flags: pd.Series, placeholder: pd.Series) -> pd.DataFrame:
    def one(source: str, marks: str, template: str):
        try:
            done = dialect.translate(source, marks)
            needle = None if done.folded else done.needle
            return done.pattern, dialect.replacement(template, done), needle, done.needle, None
        except dialect.RegexError as problem:
            return None, None, None, None, str(problem)

    rows = [one(*row) for row in zip(regex, flags, placeholder)]
    return pd.DataFrame(rows, columns=_COMPILED.fieldNames())


def numbered(raw: DataFrame, max_custom: int | None = MAX_CUSTOM_RULES, key: str | None = "repo_id") -> DataFrame:
    """Definitions with their place ``ord`` behind the built-in rules.

    The limit counts definitions, whatever becomes of them later.  With ``key`` each
    repository is counted by itself; its definitions come from one file.  Without,
    the first definitions of all are taken by a top-k; with no limit they are counted
    file by file, so none are gathered in one task.
    """
    if key is None and max_custom is None:
        return _numbered_by_file(raw)
    if key is None:
        raw = raw.orderBy(*definition_order()).limit(max_custom)
    keys = [key] if key else [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*definition_order()))
    out = raw.select("*", (place + BUILTIN_COUNT - 1).alias("ord"))
    if key is not None and max_custom is not None:
        out = out.filter(F.col("ord") < BUILTIN_COUNT + max_custom)
    return out


def _numbered_by_file(raw: DataFrame) -> DataFrame:
    """All definitions with their place; only one row per file is ordered as a whole."""
    file = ["source_rank", "folder"]
    keyed = raw.withColumn("_folder", F.coalesce("folder", F.lit("")))
    sizes = keyed.groupBy("source_rank", "_folder").agg(F.first("folder").alias("folder"), F.count("*").alias("_n"))
    before = Window.orderBy(*file).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source_rank", "_folder", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("source_rank", "_folder").orderBy("pos"))
    placed = keyed.withColumn("_within", within).join(sizes, ["source_rank", "_folder"])
    place = (F.col("_before") + F.col("_within") - 1 + BUILTIN_COUNT).cast("int").alias("ord")
    return placed.select(*raw.columns, place)


def _checked(raw: DataFrame, max_custom: int | None, key: str | None) -> DataFrame:
    enabled = numbered(raw, max_custom, key).filter("coalesce(enabled, true)")
    compiled = _compiled(
        F.col("regex"),
        F.coalesce("flags", F.lit("g")),
        F.coalesce("placeholder", F.lit(DEFAULT_PLACEHOLDER)),
    )
    return enabled.select("*", compiled.alias("_done"))


def compile_rules(
    raw: DataFrame, max_custom: int | None = MAX_CUSTOM_RULES, key: str | None = "repo_id"
) -> DataFrame:
    """The usable rules with defaults filled in; disabled and invalid ones are dropped.

    ``max_custom`` limits the definitions looked at; None takes them all.
    """
    good = _checked(raw, max_custom, key).filter("_done.error IS NULL")
    return good.select(
        *([key] if key else []),
        "ord", "id", "label", "regex",
        F.coalesce("flags", F.lit("g")).alias("flags"),
        F.col("_done.java_regex").alias("java_regex"),
        F.col("_done.replacement").alias("replacement"),
        F.col("_done.needle").alias("needle"),
        # Text that every hit holds, whether case counts or not.
        F.col("_done.literal").alias("literal"),
        F.coalesce("placeholder", F.lit(DEFAULT_PLACEHOLDER)).alias("placeholder"),
        F.expr("greatest(0D, least(100D, coalesce(risk_score, 0D)))").alias("risk"),
        F.coalesce("critical", F.lit(False)).alias("critical"),
    )


def rule_errors(
    raw: DataFrame, max_custom: int | None = MAX_CUSTOM_RULES, key: str | None = "repo_id"
) -> DataFrame:
    """One row per definition whose regex cannot be used."""
    bad = _checked(raw, max_custom, key).filter("_done.error IS NOT NULL")
    message = F.format_string(
        'ignoring custom pattern "%s" — invalid regex: %s', F.col("id"), F.col("regex")
    )
    return bad.select(
        *([key] if key else []), "id", "regex", F.col("_done.error").alias("reason"),
        message.alias("message"),
    )


def warn_once(errors: DataFrame) -> DataFrame:
    """Each message once."""
    return errors.select("message").distinct()


def find_rules(rules: DataFrame) -> DataFrame:
    """The first rule of every id."""
    kept = [c for c in rules.columns if c != "id"]
    first = F.min_by(F.struct(*kept), F.col("ord"))
    return rules.groupBy("id").agg(first.alias("_first")).select("id", "_first.*")


def collect_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Built-in rules followed by the rules of a shared set, ready to be unrolled.

    Rules are the only rows that ever reach the driver, and at most MAX_LITERAL_RULES
    of them; a larger set goes through ``match_repo_rules``.
    """
    rows = rules.orderBy("ord").limit(MAX_LITERAL_RULES + 1).collect()
    if len(rows) > MAX_LITERAL_RULES:
        raise ValueError("too many rules to unroll; scan with match_repo_rules instead")
    custom = tuple(
        Rule(r.ord, r.id, r.label, r.regex, r.flags, r.placeholder, r.risk, r.critical)
        for r in rows
    )
    return builtin_rules() + custom


def can_hit(text: str) -> str:
    """Tests for the text a rule's hits all hold.

    A regex that comes from the row is compiled for the row; this saves most of them.
    """
    return f"(r.needle IS NULL OR contains({text}, r.needle))"


def match_repo_rules(
    units: DataFrame,
    rules: DataFrame,
    key: str = "repo_id",
    text: str = "text",
    salts: int = 1,
    max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds ``matched`` and ``repo_rules`` to units scanned with their own repository's rules.

    The rules of a repository become one row before the join.  If all of them measure at
    most ``max_broadcast`` bytes they are broadcast and no text is moved.  Beyond that the
    join shuffles, and adaptive execution splits the partitions of a repository that
    holds most of the texts; where that is switched off, ``salts`` spreads every
    repository over so many keys, at the price of as many copies of its rules.
    """
    fields = (
        "ord", "id", "label", "risk", "critical", F.col("java_regex").alias("regex"),
        "replacement", "needle",
    )
    per_repo = rules.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("repo_rules")
    )
    if salts > 1:
        salt = F.pmod(F.xxhash64(F.col(text)), F.lit(salts)).alias("_salt")
        salted = per_repo.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        salted = salted.withColumn("_salt", F.col("_salt").cast("bigint"))
        joined = units.select("*", salt).join(salted, [key, "_salt"], "left")
    else:
        joined = units.join(broadcast_if_small(per_repo, max_broadcast), key, "left")
    own = (
        f"transform(filter(coalesce(repo_rules, array()), r -> {can_hit(ident(text))} "
        f"AND rlike({ident(text)}, r.regex)), "
        "r -> named_struct('ord', r.ord, 'id', r.id, 'label', r.label, 'risk', r.risk, "
        "'critical', r.critical, 'regex', r.regex))"
    )
    flagged = computed_once(joined, _flags=hit_flags(ident(text)), _own=own)
    return flagged.select(
        *units.columns, "repo_rules",
        F.expr(f"concat({matched_rules('_flags')}, _own)").alias("matched"),
    )


def sanitize_matched(matched: DataFrame, text: str = "text", out: str = "sanitized") -> DataFrame:
    """Rewrites units from ``match_repo_rules``: built-in rules first, then their own."""
    chain = (
        f"aggregate(coalesce(repo_rules, array()), {rewrite_chain(ident(text))}, "
        f"(done, r) -> if({can_hit('done')}, regexp_replace(done, r.regex, r.replacement), done))"
    )
    done = computed_once(matched, **{out: f"if(size(matched) > 0, {chain}, {ident(text)})"})
    return done.drop("repo_rules")
