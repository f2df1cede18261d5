"""Metrics of test runs, iteration by iteration.

Results are counted per run and iteration first, with partial aggregation; windows
only ever see those few rows per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _run():
    return Window.partitionBy("run_id").orderBy("iteration")


def _so_far():
    return _run().rowsBetween(Window.unboundedPreceding, Window.currentRow)


# Why a loop stops, and what is recommended after it.
MAX_REACHED, ALL_PASSED = "Maximum iterations reached", "All tests passed"
CRITICAL_SEEN, NO_CONVERGENCE = "Critical failure detected", "No convergence detected"
ADVICE = (
    "Review failed tests and implement suggested fixes",
    "Address critical issues before production deployment",
    "Consider improving test stability and retry logic",
    "Tests are not converging - review root causes",
)
DEFAULT_MAX_ITERATIONS = 5


def retry_adjust(attempts: DataFrame, keys: Sequence[str] = ("run_id", "iteration", "test_case_id")) -> DataFrame:
    """One result per test and iteration: the last attempt, with its retries counted once.

    A test that passed in the end has no error message.
    """
    kept = [c for c in attempts.columns if c not in (*keys, "attempt", "retry_count")]
    last = attempts.groupBy(*keys).agg(
        F.max_by(F.struct(*kept), "attempt").alias("_last"),
        (F.count("*") - 1).cast("int").alias("retry_count"),
    )
    out = last.select(*keys, "_last.*", "retry_count")
    if "error_message" not in kept:
        return out
    return out.withColumn(
        "error_message", F.when(F.col("status") != "pass", F.col("error_message"))
    )


def iteration_counts(results: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Tests by status and diagnoses by kind for each iteration of each run."""
    keys = ["run_id", "iteration"]
    tests = results.groupBy(*keys).agg(
        F.count("*").alias("tests"),
        F.expr("count_if(status = 'pass')").alias("passed"),
        F.expr("count_if(status IN ('fail', 'error'))").alias("failed"),
        F.expr("count_if(status = 'flaky')").alias("flaky"),
        F.expr("count_if(status = 'error')").alias("errors"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )
    found = diagnoses.groupBy(*keys).agg(
        F.count("*").alias("open_issues"),
        F.expr("count_if(suggested_fix.type = 'code-patch')").alias("issues_resolved"),
        F.expr("count_if(severity = 'critical')").alias("critical"),
    )
    counts = ("open_issues", "issues_resolved", "critical")
    return tests.join(found, keys, "left").select(
        *tests.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def open_bugs(diagnoses: DataFrame) -> DataFrame:
    """Failures that call for a code change or weigh heavily."""
    bugs = diagnoses.filter("suggested_fix.type = 'code-patch' OR severity = 'high'")
    return bugs.select(
        "run_id", "iteration", "test_case_id", "test_name",
        F.col("root_cause.category").alias("root_cause"),
        F.lit("new").alias("status"), F.lit(1).alias("iterations_open"), "severity",
    )


def running_totals(counts: DataFrame) -> DataFrame:
    """Totals up to each iteration, the mean time of an iteration, and convergence.

    Convergence is 0 in the first iteration, and null where no test ever failed.
    """
    totals = counts.select(
        "*",
        F.sum("tests").over(_so_far()).alias("total_tests"),
        F.sum("passed").over(_so_far()).alias("total_passes"),
        F.sum("failed").over(_so_far()).alias("total_failures"),
        F.sum("issues_resolved").over(_so_far()).alias("total_fixes"),
        (
            _micros(F.max("ended").over(_so_far())) - _micros(F.min("started").over(_so_far()))
        ).alias("_elapsed"),
    )
    before = F.col("total_failures") / (F.col("iteration") - 1)
    rate = F.try_divide(before - F.col("failed"), before)
    converged = F.when(rate.isNotNull(), F.greatest(F.lit(0.0), rate))
    return totals.select(
        *counts.columns, "total_tests", "total_passes", "total_failures", "total_fixes",
        (F.col("_elapsed") / 1000.0 / F.col("iteration")).alias("mean_iteration_ms"),
        F.when(F.col("iteration") > 1, converged).otherwise(F.lit(0.0)).alias("convergence_rate"),
    )


def _micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def stop_decision(
    counts: DataFrame,
    max_iterations: int = DEFAULT_MAX_ITERATIONS,
    stop_on_all_pass: bool = True,
    continue_on_critical: bool = False,
    fail_fast: bool = False,
) -> DataFrame:
    """Why a loop would stop after each iteration, the first reason that applies."""
    reason = (
        F.when(F.col("iteration") >= max_iterations, MAX_REACHED)
        .when(F.lit(stop_on_all_pass) & (F.col("failed") == 0), ALL_PASSED)
        .when(F.lit(not continue_on_critical) & (F.col("critical") > 0), CRITICAL_SEEN)
        .when(F.lit(fail_fast) & (F.col("iteration") > 2), NO_CONVERGENCE)
    )
    status = (
        F.when(F.col("stop_reason").isNull(), "running")
        .when(F.col("stop_reason").isin(MAX_REACHED, ALL_PASSED), "completed")
        .otherwise("failed")
    )
    return counts.select("*", reason.alias("stop_reason")).select("*", status.alias("status"))


def run_summary(totals: DataFrame, **loop) -> DataFrame:
    """The last iteration of each run with success and recommendations."""
    decided = stop_decision(totals, **loop)
    seen = decided.select("*", F.lag("failed").over(_run()).alias("failed_before"))
    final = seen.groupBy("run_id").agg(
        F.max_by(F.struct(*[c for c in seen.columns if c != "run_id"]), "iteration").alias("_last")
    ).select("run_id", "_last.*")
    tests = (
        F.col("failed") > 0,
        F.col("critical") > 0,
        F.col("convergence_rate") < 0.1,
        F.col("failed") >= F.col("failed_before"),
    )
    advice = F.array_compact(
        F.array(*[F.when(F.coalesce(t, F.lit(False)), text) for t, text in zip(tests, ADVICE)])
    )
    return final.select(
        "*",
        ((F.col("status") == "completed") & (F.col("failed") == 0)).alias("success"),
        advice.alias("recommendations"),
    ).drop("failed_before")
