"""Risk scores: rule weights, then path context, then count bonuses, clamp and level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions import dialect
from textwarden.functions.detect import finding_count, hit_flags, labels, matched_rules
from textwarden.functions.rules import Rule, builtin_rules
from textwarden.functions.sqltext import computed_once, ident, lit

# Weights and cut-offs.
CRITICAL_FLOOR = 60
ENV_FILE, README_FILE, TEST_FOLDER = -10, 10, -15
TEMPLATE, TEST_FILE, DOCUMENTATION, INFRASTRUCTURE = -15, -20, -10, -5
MANY_FINDINGS = ((2, 20), (4, 15))
HIGH_FROM, MEDIUM_FROM = 60, 30

# JavaScript regexes over the lower-cased path.
TEMPLATE_PATHS = (
    r"\.env\.example$", r"\.env\.template$", r"config\.template\.", r"example\.config\.",
    r"\/templates?\/",
)
NOT_TEST_PATHS = (
    r"\/testament\/", r"\/test-data\/", r"\/test_utils\/", r"\/testutils\/", r"\/testing\/",
)
TEST_PATHS = (
    r"\/__tests__\/", r"\/test\/src\/", r"\/integration\/test\/", r"\/e2e\/",
    r"\.test\.(ts|js|tsx|jsx|mjs|cjs)$", r"\.spec\.(ts|js|tsx|jsx|mjs|cjs)$",
    r"^test\.(ts|js)$", r"^tests\.(ts|js)$",
)
TEST_DIRECTORY = r"(?:\/|^)test(?:\/|$)"
DOCUMENTATION_PATHS = (r"\/docs\/", r"\/examples?\/", r"\/tutorials?\/", r"\.md$")
INFRASTRUCTURE_PATHS = (
    r"\.tf$", r"\.tfvars$", r"\/terraform\/", r"\/cloudformation\/", r"\/k8s\/",
    r"\/kubernetes\/", r"\/ansible\/",
)
# Fixed values: (regex, flags) over the text; two of them confirm a test file.
TEST_CONTENT = (
    (r"describe\(", ""), (r"^\s*(it|test)\(", "m"), (r"^\s*expect\(", "m"),
    (r"from\s+['\"]@testing-library", ""), (r"jest\.", ""), (r"vitest\.", ""),
    (r"mocha\.", ""), (r"should\(\s*\)", ""),
)
TEST_CONTENT_NEEDED = 2

CONTEXTS = ("template", "test", "documentation", "infrastructure")


def one_of(patterns: Sequence[str], target: str = dialect.JAVA) -> str:
    """One alternation of JavaScript regexes."""
    return "|".join(f"(?:{dialect.translate(p, '', target).pattern})" for p in patterns)


def _matches(column: str, patterns: Sequence[str]) -> str:
    return f"coalesce(rlike({column}, {lit(one_of(patterns))}), false)"


def _ends(column: str, suffix: str) -> str:
    return f"coalesce(endswith({column}, {lit(suffix)}), false)"


def _normal(path: str) -> str:
    return f"translate({path}, {lit(chr(92))}, '/')"


def _in_test_folder(path: str) -> str:
    return f"coalesce(contains({_normal(path)}, '/test/'), false)"


def _vote(text: str, pattern: str, flags: str) -> str:
    """1 if the regex hits, else 0; text the regex needs is looked for first."""
    regex = dialect.translate(pattern, flags)
    needed = f"contains({text}, {lit(regex.needle)}) AND " if regex.needle else ""
    return f"int(coalesce({needed}rlike({text}, {lit(regex.pattern)}), false))"


def _is_test_file(low: str, text: str) -> str:
    votes = " + ".join(_vote(text, p, f) for p, f in TEST_CONTENT)
    by_content = f"({_matches(low, (TEST_DIRECTORY,))} AND ({votes}) >= {TEST_CONTENT_NEEDED})"
    return f"(NOT {_matches(low, NOT_TEST_PATHS)} AND ({_matches(low, TEST_PATHS)} OR {by_content}))"


def _by_context(path: str, text: str, results: Sequence[str], otherwise: str) -> str:
    """The result of the first context that applies."""
    normal = _normal(path)
    low = f"lower({normal})"
    tests = (
        _matches(low, TEMPLATE_PATHS),
        f"NOT {_in_test_folder(path)} AND {_is_test_file(low, text)}",
        f"NOT {_ends(normal, 'README.md')} AND {_matches(low, DOCUMENTATION_PATHS)}",
        _matches(low, INFRASTRUCTURE_PATHS),
    )
    whens = " ".join(f"WHEN {test} THEN {result}" for test, result in zip(tests, results))
    return f"CASE {whens} ELSE {otherwise} END"


def path_context(path: str = "path", text: str = "text") -> str:
    """The first context that applies to the unit, or null; arguments are SQL expressions."""
    return _by_context(path, text, [lit(name) for name in CONTEXTS], "NULL")


def path_modifier(path: str = "path", text: str = "text") -> str:
    """What the path adds to the score; a missing or empty path adds nothing."""
    normal = _normal(path)
    values = (TEMPLATE, TEST_FILE, DOCUMENTATION, INFRASTRUCTURE)
    return (
        f"(if({_ends(normal, '.env')}, {ENV_FILE}, 0) "
        f"+ if({_ends(normal, 'README.md')}, {README_FILE}, 0) "
        f"+ if({_in_test_folder(path)}, {TEST_FOLDER}, 0) "
        f"+ {_by_context(path, text, [str(v) for v in values], '0')})"
    )


def base_score(matched: Column) -> Column:
    """Sum of the risks of the matched rules, each once."""
    return F.aggregate(matched, F.lit(0.0), lambda total, rule: total + rule["risk"])


def floored_score(matched: Column) -> Column:
    """Base score, lifted to the floor when a critical rule hit."""
    base = base_score(matched)
    critical = F.exists(matched, lambda rule: rule["critical"])
    return F.when(critical, F.greatest(base, F.lit(float(CRITICAL_FLOOR)))).otherwise(base)


def count_bonus(count: Column) -> Column:
    total = F.lit(0)
    for least, value in MANY_FINDINGS:
        total = total + F.when(count >= least, F.lit(value)).otherwise(F.lit(0))
    return total


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")
    )


def score_units(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Adds ``score``, ``findings``, ``finding_count`` and ``level``.

    ``score`` is INT when every rule weight is a whole number, else DOUBLE.
    """
    rules = builtin_rules() if rules is None else rules
    whole = all(float(r.risk).is_integer() for r in rules)
    computed = {"_flags": hit_flags(ident(text), rules)}
    if path:
        computed["_modifier"] = path_modifier(ident(path), ident(text))
    modifier = "_modifier" if path else "0"
    scanned = computed_once(df, **computed).select(
        *df.columns, F.expr(f"{modifier} AS _modifier"), F.expr(matched_rules("_flags", rules)).alias("matched")
    )
    return _scored(scanned, whole)


def score_matched(
    df: DataFrame, text: str = "text", path: str | None = None, whole: bool = True
) -> DataFrame:
    """The same for a frame that already holds ``matched``, which is dropped."""
    modifier = path_modifier(ident(path), ident(text)) if path else "0"
    return _scored(computed_once(df, _modifier=modifier), whole)


def _scored(df: DataFrame, whole: bool) -> DataFrame:
    kept = [c for c in df.columns if c not in ("matched", "_modifier")]
    matched = F.col("matched")
    raw = floored_score(matched) + F.col("_modifier") + count_bonus(finding_count(matched))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    scored = df.select(
        *kept,
        (clamped.cast("int") if whole else clamped).alias("score"),
        labels(matched).alias("findings"),
        finding_count(matched).alias("finding_count"),
    )
    return scored.select("*", risk_level(F.col("score")).alias("level"))


def risk_text(score: Column) -> Column:
    return F.concat(risk_level(score), F.lit(" RISK"))
