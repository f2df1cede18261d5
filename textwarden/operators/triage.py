"""Triage of test-run failures: cause, fix, evidence, severity, and recurring failures.

Input rows are test results ``(run_id, iteration, seq, ts, test_case_id, test_name, status,
duration, error_message, stack_trace, screenshots, logs, traces, retry_count)``.  A
diagnosis is computed inside its row; only the optional test cases are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions import dialect
from textwarden.functions.sqltext import lit
from textwarden.operators.prefix import DEFAULT_WIDTH, prefix_scan
from textwarden.operators.staging import stage

# JavaScript regexes, with flags, that decide the category of an error.
EXTENSION_ERRORS = (
    (r"Extension\[.*\]\.error", ""), (r"Cannot read property", ""), (r"Cannot set property", ""),
    (r"TypeError", ""), (r"ReferenceError", ""), (r"Command.*failed", ""),
    (r"not accessible", ""), (r"permission denied", "i"),
)
TEST_ERRORS = (
    (r"timeout", ""), (r"element.*not found", "i"), (r"selector.*failed", "i"),
    (r"assertion.*failed", "i"), (r"expected.*but got", "i"), (r"no\s+such\s+command", "i"),
)
ENVIRONMENT_ERRORS = (
    (r"network\s+error", "i"), (r"connection\s+refused", "i"), (r"unable\s+to\s+connect", "i"),
    (r"port\s+\d+\s+already\s+in\s+use", "i"), (r"workspace\s+not\s+found", "i"),
    (r"file\s+not\s+found", "i"), (r"permission\s+denied", "i"), (r"out\s+of\s+memory", "i"),
)
# Component names, in the order they are looked for.
COMPONENTS = (
    "sanitizer", "riskEngine", "patternRegistry", "eventManager", "sensitiveDetector", "repoConfig",
)
# Words that make a bug critical.
CRITICAL_WORDS = ("security", "leak", "sensitive")
# Where a stack line names a file, and where a line number.
STACK_FILES = (r"at\s+.*\s+\((.*\.ts):\d+:\d+\)", r"(.*\.ts):\d+:\d+")
STACK_LINES = (r":(\d+):\d+\)", r":(\d+):\d+$")
READ_PROPERTY, QUOTED_WORD = r"Cannot read property '(\w+)'", r"'(\w+)'"

FAILED = ("fail", "error")
KEPT_LOGS = 100


def error_regex(patterns: Sequence[tuple[str, str]], target: str = dialect.JAVA) -> str:
    return "|".join(f"(?:{dialect.translate(p, f, target).pattern})" for p, f in patterns)


def _says(*words: str) -> str:
    return " AND ".join(f"contains(error, {lit(w)})" for w in words)


def _java(pattern: str) -> str:
    return lit(dialect.translate(pattern).pattern)


def _group(column: str, pattern: str) -> str:
    return f"nullif(regexp_extract({column}, {_java(pattern)}, 1), '')"


def _cases(branches: Sequence[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {whens} ELSE {default} END"


def _by_category(extension: str, test: str, environment: str, timing: str) -> str:
    return (
        f"CASE category WHEN 'extension-bug' THEN {extension} WHEN 'test-issue' THEN {test} "
        f"WHEN 'environment-issue' THEN {environment} ELSE {timing} END"
    )


_CATEGORY = _cases(
    [
        (f"rlike(error, {lit(error_regex(EXTENSION_ERRORS))})", "'extension-bug'"),
        (f"rlike(error, {lit(error_regex(TEST_ERRORS))})", "'test-issue'"),
        (f"rlike(error, {lit(error_regex(ENVIRONMENT_ERRORS))})", "'environment-issue'"),
    ],
    "'timing-issue'",
)

# What is said about each kind of failure.
_DESCRIPTION = _by_category(
    _cases(
        [
            (
                _says("Cannot read property"),
                "concat('Extension attempted to read undefined property ''', "
                f"coalesce({_group('error', READ_PROPERTY)}, 'unknown'), '''')",
            ),
            (_says("Cannot set property"), "'Extension attempted to write to a read-only property'"),
            (_says("TypeError"), "'Type mismatch in extension code'"),
        ],
        "'Unknown extension error occurred'",
    ),
    _cases(
        [
            (
                _says("timeout"),
                "concat('Test timed out after ', duration, "
                "'ms - possible infinite loop or slow operation')",
            ),
            (_says("element", "not found"), "'Test expected element not found in UI'"),
            (
                f"{_says('assertion')} OR {_says('expected')}",
                "'Test assertion failed - actual output differs from expected'",
            ),
        ],
        "'Test configuration or setup issue'",
    ),
    _cases(
        [
            (_says("network"), "'Network connectivity issue during test execution'"),
            (_says("port"), "'Port conflict - another process using test port'"),
            (
                f"{_says('workspace')} OR {_says('file')}",
                "'Test workspace or file not accessible'",
            ),
        ],
        "'Environment configuration issue'",
    ),
    "concat('Asynchronous timing issue - operation took ', duration, 'ms')",
)

_TRIM = lit(rf"\A[{dialect.space_class()}]+|[{dialect.space_class()}]+\z")
_LOCATION = (
    "regexp_replace(get(filter(split(stack, '\\n', -1), "
    f"s -> contains(s, '.ts:') OR contains(s, '.js:')), 0), {_TRIM}, '')"
)


def _component(strict: bool) -> str:
    """``strict`` looks for the names as written in the lower-cased error, as the rules say;
    otherwise case does not matter."""
    names = [(f"contains(lower(error), {lit(n if strict else n.lower())})", lit(n)) for n in COMPONENTS]
    return _cases(names, "'unknown-component'")


def _first_in_stack(patterns: Sequence[str]) -> str:
    found = ", ".join(_group("s", p) for p in patterns)
    return (
        f"get(filter(transform(split(stack, '\\n', -1), s -> coalesce({found})), "
        "s -> s IS NOT NULL), 0)"
    )


_CONFIDENCE = """least(100, 50
    + 10 * least(greatest(coalesce(retry_count, 0), 0), 3)
    + if(length(error) > 50, 15, 0)
    + if(coalesce(size(screenshots), 0) > 0, 10, 0)
    + if(length(stack) > 100, 10, 0)
    + if(coalesce(location, '') <> '', 5, 0))"""

_SEVERITY = _cases(
    [
        (
            "category = 'extension-bug' AND ("
            + " OR ".join(_says(w) for w in CRITICAL_WORDS) + ")",
            "'critical'",
        ),
        (
            "(category = 'extension-bug' AND contains(test_name, 'core')) "
            "OR contains(test_name, 'critical')",
            "'high'",
        ),
        (
            "category = 'extension-bug' OR (category = 'test-issue' AND coalesce(retry_count, 0) > 2)",
            "'medium'",
        ),
    ],
    "'low'",
)

_NO_PATCH = (
    "CAST(NULL AS struct<file:string,line:bigint,original_code:string,fixed_code:string,"
    "explanation:string,language:string,risk:string>)"
)
_NO_CORRECTION = "CAST(NULL AS struct<issue:string,correction:string,line:bigint,file:string>)"


def _patch(original: str, fixed: str, explanation: str, risk: str) -> str:
    return (
        f"named_struct('file', coalesce({_first_in_stack(STACK_FILES)}, 'unknown-file.ts'), "
        f"'line', coalesce(try_cast({_first_in_stack(STACK_LINES)} AS bigint), 0L), "
        f"'original_code', {original}, 'fixed_code', {fixed}, 'explanation', {explanation}, "
        f"'language', 'typescript', 'risk', '{risk}')"
    )


def _correction(issue: str, correction: str, line: str = "CAST(NULL AS bigint)") -> str:
    return (
        f"named_struct('issue', {issue}, 'correction', {correction}, 'line', {line}, "
        "'file', coalesce(case_id, 'unknown'))"
    )


def _fix(kind, description, priority, effort, patch=_NO_PATCH, correction=_NO_CORRECTION) -> str:
    return (
        f"named_struct('type', '{kind}', 'description', {description}, 'priority', '{priority}', "
        f"'estimated_effort', '{effort}', 'patch', {patch}, 'test_correction', {correction})"
    )


_PROPERTY = f"coalesce({_group('error', QUOTED_WORD)}, 'property')"

# The fix proposed for each kind of failure.
_CODE_FIX = _cases(
    [
        (
            _says("Cannot read property"),
            _fix(
                "code-patch", f"concat('Add null check for property ''', {_PROPERTY}, '''')",
                "high", "low",
                _patch(
                    "'// original code with missing check'",
                    f"concat('if (', {_PROPERTY}, ' && ', {_PROPERTY}, "
                    "'.hasOwnProperty) { /* safe access */ }')",
                    f"concat('Add defensive check before accessing ''', {_PROPERTY}, "
                    "''' to prevent undefined access errors')",
                    "low",
                ),
            ),
        ),
        (
            _says("undefined"),
            _fix(
                "code-patch", "'Initialize missing variable or add null check'", "high", "low",
                _patch(
                    "'// code with uninitialized variable'",
                    "'const variable = defaultValue || safeFallback;'",
                    "'Initialize variable with safe default value'",
                    "low",
                ),
            ),
        ),
    ],
    _fix(
        "code-patch", "'Fix extension bug in core logic'", "high", "medium",
        _patch(
            "'// Bug in extension code'", "'// Fixed extension code'",
            "'Resolve bug based on failure analysis'", "medium",
        ),
    ),
)
_TEST_FIX = _cases(
    [
        (
            _says("timeout"),
            _fix(
                "test-correction", "'Increase test timeout limit'", "medium", "low",
                correction=_correction(
                    "'Test timeout - operation taking too long'",
                    "concat('Increase timeout from default to ', "
                    "coalesce(nullif(duration, 0), 5000) * 2, 'ms')",
                    "0L",
                ),
            ),
        ),
        (
            _says("element", "not found"),
            _fix(
                "test-correction", "'Fix element selector or add wait'", "medium", "medium",
                correction=_correction(
                    "'Element selector incorrect or element not yet rendered'",
                    "'Update selector or add explicit wait for element'",
                ),
            ),
        ),
        (
            _says("assertion"),
            _fix(
                "test-correction", "'Fix test assertion logic'", "high", "low",
                correction=_correction(
                    "'Assertion logic does not match actual behavior'",
                    "'Update expected values to match correct behavior'",
                ),
            ),
        ),
    ],
    _fix(
        "test-correction", "'General test correction needed'", "medium", "medium",
        correction=_correction("'Test needs adjustment'", "'Review and update test logic'"),
    ),
)
_FIX = _by_category(
    _CODE_FIX,
    _TEST_FIX,
    _fix("configuration-change", "'Adjust test environment configuration'", "medium", "low"),
    _fix(
        "test-correction", "'Increase wait times or add explicit waits'", "low", "low",
        correction=_correction(
            "'Timing-related flakiness'", "'Add explicit waits for async operations'"
        ),
    ),
)


def _proof(kind: str, description: str, data: str, present: str) -> str:
    return (
        f"if({present}, named_struct('type', '{kind}', 'description', {description}, "
        f"'data', {data}, 'timestamp', ts), NULL)"
    )


_EVIDENCE = (
    "array_compact(array("
    + ", ".join(
        [
            _proof("error", "'Error message from test failure'", "array(error)", "error <> ''"),
            _proof("error", "'Stack trace from error'", "array(stack)", "stack <> ''"),
            _proof(
                "screenshot",
                "concat('Screenshots from test failure (', size(screenshots), ' files)')",
                "screenshots", "coalesce(size(screenshots), 0) > 0",
            ),
            _proof(
                "log", "'Application logs from test execution'",
                f"slice(logs, greatest(size(logs) - {KEPT_LOGS - 1}, 1), {KEPT_LOGS})",
                "coalesce(size(logs), 0) > 0",
            ),
            _proof("trace", "'Playwright trace files'", "traces", "coalesce(size(traces), 0) > 0"),
        ]
    )
    + "))"
)


def failed_only(results: DataFrame) -> DataFrame:
    """Results that are diagnosed; a flaky one is not."""
    return results.filter(F.col("status").isin(*FAILED))


def join_case(results: DataFrame, cases: DataFrame | None) -> DataFrame:
    """Adds ``case_id``: the id of the test case if there is one, else null."""
    if cases is None:
        return results.withColumn("case_id", F.lit(None).cast("string"))
    known = cases.select(F.col("id").alias("test_case_id")).distinct()
    known = known.withColumn("case_id", F.col("test_case_id"))
    return results.join(known, "test_case_id", "left")


def diagnose(
    results: DataFrame, cases: DataFrame | None = None, strict_components: bool = True
) -> DataFrame:
    """One diagnosis per failed result."""
    failed = join_case(failed_only(results), cases)
    texts = failed.selectExpr(
        "*", "coalesce(error_message, '') AS error", "coalesce(stack_trace, '') AS stack"
    )
    categorised = texts.selectExpr("*", f"{_CATEGORY} AS category")
    caused = categorised.selectExpr(
        "*",
        f"{_DESCRIPTION} AS cause",
        f"{_by_category(_LOCATION, 'case_id', 'NULL', 'NULL')} AS location",
        f"{_by_category(_component(strict_components), 'NULL', lit('test-environment'), lit('async-execution'))} "
        "AS component",
    )
    kept = [c for c in ("run_id", "iteration", "seq", "ts") if c in results.columns]
    return caused.selectExpr(
        *kept, "test_case_id", "test_name",
        "named_struct('category', category, 'description', cause, 'location', location, "
        "'affected_component', component) AS root_cause",
        f"{_CONFIDENCE} AS confidence",
        f"{_FIX} AS suggested_fix",
        f"{_EVIDENCE} AS evidence",
        f"{_SEVERITY} AS severity",
    )


def recurring_failures(diagnoses: DataFrame) -> DataFrame:
    """How often each category and component failed, when last, and the first fix proposed."""
    key = F.concat_ws(
        "-",
        F.col("root_cause.category"),
        F.coalesce(F.col("root_cause.affected_component"), F.lit("undefined")),
    )
    return (
        diagnoses.groupBy(key.alias("pattern_id"), F.col("root_cause.category").alias("failure_type"))
        .agg(
            F.count("*").alias("frequency"),
            F.max("ts").alias("last_occurrence"),
            F.lit(1.0).alias("average_resolution_time"),
            F.min_by("suggested_fix.description", "seq").alias("suggested_action"),
        )
    )


def top_recurring(recurring: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent, ties by name."""
    return recurring.orderBy(F.desc("frequency"), "pattern_id").limit(n)


def failure_history(diagnoses: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Diagnoses with their ``place`` in the history of their test case, from 1.

    The history stays rows.  A list per test case would put every failure of a test
    that always fails into one task.
    """
    # Only the numbers are cut into chunks and counted; the diagnoses meet their place by number.
    numbers = stage(diagnoses.select("test_case_id", "seq"))
    counted = prefix_scan(numbers, ["test_case_id"], "seq", sums={"_before": "1L"}, width=width)
    placed = diagnoses.join(counted, ["test_case_id", "seq"])
    return placed.select(*diagnoses.columns, (F.col("_before") + 1).alias("place"))
