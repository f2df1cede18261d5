"""Gates over change sets, and the messages and actions that go with a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detect import any_hit
from textwarden.functions.rewrite import rewrite_chain
from textwarden.functions.risk import risk_text, score_units
from textwarden.functions.rules import MAX_TEXT_BYTES, Rule
from textwarden.functions.sqltext import computed_once, ident
from textwarden.functions.text import fits
from textwarden.sources.corpus import changed_only, is_scanned, size_gate

COPY_SANITIZED, COPY_RAW, CANCEL = "copy-sanitized", "copy-raw", "cancel"

# Colour shown for each level.
LEVEL_COLOURS = {"HIGH": "#f14c4c", "MEDIUM": "#cca700", "LOW": "#8dc891"}


def gate_units(
    changes: DataFrame,
    rules: Sequence[Rule] | None = None,
    max_bytes: int | None = MAX_TEXT_BYTES,
    text: str = "text",
) -> DataFrame:
    """The units of a change feed that the gate scans."""
    return size_gate(changed_only(changes), max_bytes, text)


def gate_verdict(
    changes: DataFrame,
    rules: Sequence[Rule] | None = None,
    key: str = "change_id",
    max_bytes: int | None = MAX_TEXT_BYTES,
    text: str = "text",
) -> DataFrame:
    """One row per change set: blocked if any scanned unit has a finding of any level.

    Change sets whose units are all skipped pass; ``skipped_units`` counts those that
    would be scanned but are larger than the limit.  An error fails the job.
    """
    wanted = F.coalesce(is_scanned(F.col("change_type"), F.col("path")), F.lit(False))
    fitting = fits(F.col(text), max_bytes)
    marked = computed_once(
        changes.select(key, text, (wanted & fitting).alias("_scanned"), (wanted & ~fitting).alias("_skipped")),
        offends=f"_scanned AND {any_hit(ident(text), rules)}",
    )
    return marked.groupBy(key).agg(
        F.when(F.max("offends"), "block").otherwise("pass").alias("verdict"),
        F.count_if("offends").alias("offending_units"),
        F.count_if("_skipped").alias("skipped_units"),
    )


def gate_report(
    changes: DataFrame,
    rules: Sequence[Rule] | None = None,
    max_bytes: int | None = MAX_TEXT_BYTES,
    text: str = "text",
    path: str = "path",
) -> DataFrame:
    """One line per offending unit; it names labels, never the text found."""
    scored = score_units(gate_units(changes, rules, max_bytes, text), rules, text, path)
    kept = [c for c in changes.columns if c != text]
    line = F.format_string(
        "%s: %s risk (score %s) — %s",
        F.col(path),
        F.col("level"),
        F.col("score").cast("string"),
        F.array_join("findings", ", "),
    )
    return scored.filter(F.col("finding_count") > 0).select(
        *kept, "score", "level", line.alias("report")
    )


def warn_message(score: Column, level: Column, findings: Column) -> Column:
    return F.format_string(
        "Risk %s/100 (%s) — %s", score.cast("string"), level, F.array_join(findings, ", ")
    )


def alerts(scored: DataFrame) -> DataFrame:
    """Scored units of level MEDIUM and HIGH, with their warning."""
    message = warn_message(F.col("score"), F.col("level"), F.col("findings"))
    return scored.filter(F.col("level") != "LOW").select("*", message.alias("message"))


def status_summary(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    max_bytes: int | None = MAX_TEXT_BYTES,
    text: str = "text",
    path: str | None = "path",
) -> DataFrame:
    """Status text, tooltip and colour per unit; texts over the limit are not scanned."""
    kept = [c for c in df.columns if c != text]
    fitting = fits(F.col(text), max_bytes)
    # A text over the limit is scanned as if empty, so its regexes cost nothing.
    gated = df.select(*kept, fitting.alias("_fits"), F.when(fitting, F.col(text)).alias(text))
    scored = score_units(gated, rules, text, path)
    colour = F.lit(None).cast("string")
    for level, value in LEVEL_COLOURS.items():
        colour = F.when(F.col("level") == level, value).otherwise(colour)
    shown = F.format_string("%s (%s)", F.col("level"), F.col("score").cast("string"))
    tip = F.format_string(
        "Sensitive data risk: %s. %d finding(s).", F.col("level"), F.col("finding_count")
    )
    fits_now = F.col("_fits")
    return scored.select(
        *kept,
        F.when(fits_now, shown).otherwise("File too large").alias("status"),
        F.when(fits_now, tip)
        .otherwise(F.format_string("File exceeds %dKB scanning limit", F.lit((max_bytes or 0) // 1024)))
        .alias("tooltip"),
        F.when(fits_now, colour).alias("colour"),
    )


def apply_actions(
    df: DataFrame,
    decisions: DataFrame,
    rules: Sequence[Rule] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Applies one decision per unit and drops cancelled units.

    A unit without findings is copied as it is, decision or not; a unit with findings
    and without a decision is cancelled.  Units are scanned before the join, so
    decisions travel to the units and rules run once.
    """
    found = computed_once(df, _found=any_hit(ident(text), rules))
    joined = found.join(decisions.select(key, "action"), key, "left")
    action = F.when(~F.col("_found"), COPY_RAW).otherwise(F.coalesce("action", F.lit(CANCEL)))
    decided = joined.select(*df.columns, "_found", action.alias("action"))
    kept = decided.filter(F.col("action") != CANCEL)
    rewrite = f"_found AND action = '{COPY_SANITIZED}'"
    copied = f"if({rewrite}, {rewrite_chain(ident(text), rules)}, {ident(text)})"
    return kept.select(*df.columns, "action", F.expr(copied).alias("copied"))


def risk_notes(scored: DataFrame) -> DataFrame:
    """Adds the display text of the score."""
    return scored.select("*", risk_text(F.col("score")).alias("risk_text"))
