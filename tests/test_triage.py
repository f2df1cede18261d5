from pyspark.sql import functions as F

from textwarden.operators.runs import (
    iteration_counts, open_bugs, retry_adjust, run_summary, running_totals, stop_decision,
)
from textwarden.operators.triage import diagnose, failed_only, failure_history, recurring_failures, top_recurring
from textwarden.sources.run_logs import append_diagnoses, load_diagnoses, write_run_report

SCHEMA = (
    "seq BIGINT, ts TIMESTAMP, run_id STRING, iteration INT, test_case_id STRING, test_name STRING, "
    "status STRING, duration BIGINT, error_message STRING, stack_trace STRING, screenshots ARRAY<STRING>, "
    "logs ARRAY<STRING>, traces ARRAY<STRING>, retry_count INT"
)


def results(spark, rows):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    full = []
    for i, r in enumerate(rows):
        full.append((
            i, base + dt.timedelta(seconds=i), r.get("run", "r"), r.get("iteration", 1), r.get("case", f"c{i}"),
            r.get("name", "t"), r.get("status", "fail"), r.get("duration", 7), r.get("error"), r.get("stack"),
            r.get("shots"), r.get("logs"), r.get("traces"), r.get("retries", 0),
        ))
    return spark.createDataFrame(full, SCHEMA)


MESSAGES = [
    ("Cannot read property 'tariff' of a closed row", "extension-bug"),
    ("ReferenceError", "extension-bug"), ("nightly: Command sync failed, timeout", "extension-bug"),
    ("balance drifted", "timing-issue"), ("Expected three rows", "timing-issue"), ("expected 3 but got 4", "test-issue"),
    ("command failed", "timing-issue"),
    ("timeout", "test-issue"), ("TIMEOUT", "timing-issue"), ("Element x not found", "test-issue"),
    ("PERMISSION DENIED", "extension-bug"), ("permission  denied", "environment-issue"),
    ("Out of memory", "environment-issue"), (None, "timing-issue"),
]


def test_categories(spark):
    rows = diagnose(results(spark, [{"error": m} for m, _ in MESSAGES])).orderBy("seq").collect()
    assert [r.root_cause.category for r in rows] == [c for _, c in MESSAGES]
    assert rows[0].root_cause.description == "Extension attempted to read undefined property 'tariff'"
    assert rows[7].root_cause.description.startswith("Test timed out after 7ms")


def test_only_failures_are_diagnosed(spark):
    df = results(spark, [{"status": s} for s in ("pass", "fail", "flaky", "error")])
    assert failed_only(df).count() == 2 and diagnose(df).count() == 2


def test_details(spark):
    stack = "Error: x\n    at Object.run (src/a.ts:45:15)\n  at other (b.ts:1:2)" + " " * 60
    df = results(spark, [
        {"error": "Cannot read property 'k' of null in Sanitizer " + "x" * 20, "stack": stack, "shots": ["s"],
         "logs": [str(i) for i in range(150)], "traces": [], "retries": 5, "name": "core"},
        {"error": "element #a not found", "case": "known", "retries": 3},
        {"error": "timeout", "duration": 0}, {"error": "connection refused"},
        {"error": "TypeError: leak", "stack": ""}, {"error": "x", "name": "critical thing"},
        {"error": "repoConfig TypeError"},
    ])
    cases = spark.createDataFrame([("known", "n"), ("known", "n2")], "id STRING, name STRING")
    a, b, c, d, e, f, g = diagnose(df, cases).orderBy("seq").collect()
    assert a.root_cause.location == "at Object.run (src/a.ts:45:15)"
    assert a.root_cause.affected_component == "sanitizer" and a.severity == "high" and a.confidence == 100
    patch = a.suggested_fix.patch
    assert (patch.file, patch.line, patch.fixed_code) == (
        "src/a.ts", 45, "if (k && k.hasOwnProperty) { /* safe access */ }")
    assert [x.type for x in a.evidence] == ["error", "error", "screenshot", "log"]
    assert a.evidence[3].data[0] == "50" and len(a.evidence[3].data) == 100
    assert b.root_cause.location == "known" and b.suggested_fix.test_correction.file == "known"
    assert b.severity == "medium" and b.confidence == 50 + 30 + 5
    assert c.suggested_fix.test_correction.correction == "Increase timeout from default to 10000ms"
    assert c.suggested_fix.test_correction.file == "unknown"
    assert d.suggested_fix.type == "configuration-change" and d.suggested_fix.patch is None
    assert e.severity == "critical" and e.suggested_fix.patch.file == "unknown-file.ts" and e.suggested_fix.patch.line == 0
    assert f.severity == "high" and f.root_cause.category == "timing-issue"
    assert g.root_cause.affected_component == "unknown-component"
    loose = diagnose(df, strict_components=False).orderBy("seq").collect()
    assert loose[6].root_cause.affected_component == "repoConfig"


def test_recurring_and_history(spark, tmp_path):
    rows = [{"error": "timeout", "case": "a"}, {"error": "TypeError", "case": "a"}, {"error": "timeout", "case": "b"}]
    found = diagnose(results(spark, rows))
    top = top_recurring(recurring_failures(found), 1).first()
    assert (top.pattern_id, top.frequency, top.average_resolution_time) == ("test-issue-undefined", 2, 1.0)
    history = failure_history(found, width=2).orderBy("seq").collect()
    assert [(r.test_case_id, r.place) for r in history] == [("a", 1), ("a", 2), ("b", 1)]
    log = str(tmp_path / "log")
    assert load_diagnoses(spark, log, found.schema).count() == 0
    append_diagnoses(found, log)
    append_diagnoses(found, log)
    assert load_diagnoses(spark, log, found.schema).count() == 6
    # Numbered batches are written once, however often they are tried.
    for batch in (0, 1, 0, 1, 1):
        append_diagnoses(found.filter(F.col("seq") >= batch), log, batch)
    late = found.filter(F.col("seq") >= 1).count()
    kept = load_diagnoses(spark, log, found.schema)
    assert kept.count() == 6 + found.count() + late and kept.columns == found.columns


def runs(spark):
    plan = {1: ["fail", "fail", "pass", "flaky"], 2: ["fail", "pass", "pass", "pass"], 3: ["pass"] * 4}
    rows = [{"iteration": i, "status": s, "case": f"c{k}", "error": "TypeError"} for i, l in plan.items() for k, s in enumerate(l)]
    return results(spark, rows)


def test_run_metrics(spark, tmp_path):
    df = runs(spark)
    found = diagnose(df)
    counts = iteration_counts(df, found)
    got = {r.iteration: (r.tests, r.passed, r.failed, r.flaky, r.issues_resolved) for r in counts.collect()}
    assert got == {1: (4, 1, 2, 1, 2), 2: (4, 3, 1, 0, 1), 3: (4, 4, 0, 0, 0)}
    totals = running_totals(counts).orderBy("iteration").collect()
    assert [r.total_failures for r in totals] == [2, 3, 3]
    assert [round(r.convergence_rate, 6) for r in totals] == [0.0, round(2 / 3, 6), 1.0]
    assert [round(r.mean_iteration_ms, 3) for r in totals] == [3000.0, 3500.0, 3666.667]
    stops = {r.iteration: (r.stop_reason, r.status) for r in stop_decision(counts).collect()}
    assert stops == {1: (None, "running"), 2: (None, "running"), 3: ("All tests passed", "completed")}
    last = run_summary(running_totals(counts)).first()
    assert last.success and last.recommendations == []
    assert open_bugs(found).count() == 3
    write_run_report(run_summary(running_totals(counts)), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).first().status == "completed"


def test_runs_that_never_fail_have_no_rate(spark):
    df = results(spark, [{"iteration": i, "status": "pass"} for i in (1, 2)])
    rates = running_totals(iteration_counts(df, diagnose(df))).orderBy("iteration").collect()
    assert [r.convergence_rate for r in rates] == [0.0, None]


def test_stop_reasons(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 1), ("a", 5, 1, 0), ("a", 3, 1, 0), ("a", 2, 0, 1)],
        "run_id STRING, iteration INT, failed INT, critical INT",
    )
    got = {r.iteration: r.stop_reason for r in stop_decision(df, fail_fast=True).collect()}
    assert got == {1: "Critical failure detected", 5: "Maximum iterations reached",
                   3: "No convergence detected", 2: "All tests passed"}


def test_last_attempt_wins(spark):
    df = results(spark, [{"case": "a", "error": "x"}, {"case": "a", "status": "pass", "error": "x"}, {"case": "b", "error": "y"}])
    got = {r.test_case_id: (r.status, r.retry_count, r.error_message) for r in retry_adjust(df.withColumn("attempt", F.col("seq"))).collect()}
    assert got == {"a": ("pass", 1, None), "b": ("fail", 0, "y")}
