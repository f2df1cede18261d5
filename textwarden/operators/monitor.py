"""The text monitor over a table of ticks.

A tick is one look at an owner's current text.  Rows are
``(owner, seq, ts, kind, text, path, choice)``; ``kind`` is ``tick``, ``suppress``
(skip one tick to come) or ``decision`` (the answer to the alert of the last tick:
``sanitize``, ``ignore`` or ``allow``).  A decision for which no alert waits is refused.

Every text is scanned where it lies and reduced to a hash, a score and labels; only those
narrow rows are shuffled and ordered.  Rows that lie together and share a text are scanned as
one.  No text is rewritten to find outcomes (``operators/ticks.py`` says why that is enough);
``sanitized_texts`` rewrites those that a decision asks for.

Whether a tick alerts depends on the decisions before it, and whether these count depends
on alerts, so no sum or minimum over an owner's rows says it.  The rows are cut into
chunks of about equally many (``operators/prefix.py``) and each is run as if nothing came
before.  A chunk hands on the state of its last owner and the paths that owner ignored.
Chunks that were given something else than they would be now are run again, all at once,
until nothing changes.  The first chunk is right from the start and each round settles at
least one more of an owner, so this ends; since a state is forgotten within a few ticks, it
ends after a few rounds, whatever the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.functions.detect import with_matched
from textwarden.functions.rewrite import sanitize
from textwarden.functions.risk import score_matched
from textwarden.functions.rules import MAX_TEXT_BYTES, Rule, builtin_rules
from textwarden.operators.gate import warn_message
from textwarden.operators.prefix import DEFAULT_WIDTH, chunked, prefix_scan
from textwarden.operators.staging import stage
from textwarden.operators.ticks import SAYS, pack, run_chunk

SANITIZE, IGNORE, ALLOW = "sanitize", "ignore", "allow"
KINDS = ("tick", "suppress", "decision")
OUTCOMES = ("suppressed", "unchanged", "too_large", "ignored", "low", "alert")

EMPTY_KEY = "sha2('', 256)"


def bad_rows(rows: DataFrame) -> DataFrame:
    """Rows that cannot be processed, with the reason; they belong in an error table."""
    reason = (
        F.when(F.col("owner").isNull(), "no owner")
        .when(F.col("seq").isNull(), "no sequence number")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
    )
    return rows.select("*", reason.alias("reason")).filter("reason IS NOT NULL")


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(
        F.col("owner").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*KINDS)
    )


def narrow_ticks(
    rows: DataFrame, rules: Sequence[Rule] | None = None, max_bytes: int = MAX_TEXT_BYTES
) -> DataFrame:
    """Each row without its text, but with everything the monitor asks of the text."""
    rules = builtin_rules() if rules is None else rules
    plain = rows.withColumn(
        "text", F.when(F.col("kind") == "tick", F.coalesce("text", F.lit("")))
    )
    rest = [f for f in plain.schema.fields if f.name != "text"]
    packed = plain.mapInArrow(
        pack, T.StructType([T.StructField("text", T.StringType()), T.StructField("rows", T.ArrayType(T.StructType(rest)))])
    )
    sized = packed.select(
        "*",
        F.sha2("text", 256).alias("text_key"),
        (F.col("text") == "").alias("is_empty"),
        (F.octet_length("text") > max_bytes).alias("too_large"),
    )
    gated = sized.withColumn("text", F.when(~F.col("too_large"), F.col("text")))
    whole = all(float(r.risk).is_integer() for r in rules)
    found = ["text", "text_key", "is_empty", "too_large", "matched"]
    # The rows of a text differ in their paths, so they are scored one by one.
    each = with_matched(gated, rules).select(*found, F.expr("inline(rows)"))
    scored = score_matched(each, path="path", whole=whole)
    kept = [c for c in rows.columns if c != "text"]
    return scored.select(*kept, "text_key", "is_empty", "too_large", "score", "level", "findings")


_STATE = ("opened", "memory", "alert_seq", "alert_path")


def _given(said: DataFrame, firsts: DataFrame, paths: DataFrame) -> DataFrame:
    """What each chunk should be given, by what the chunks said last.

    Only a chunk's first owner may have begun in an earlier one, which then ended with it.
    """
    before = Window.orderBy("chunk")  # a row a chunk
    ends = said.filter("what = 'state'").select("chunk", "owner", *_STATE)
    handed = ends.select(
        (F.lead("chunk").over(before)).alias("chunk"), "owner", *_STATE
    ).join(firsts, ["chunk", "owner"], "left_semi")
    earlier = said.filter("what = 'ignored'").groupBy("owner", "path").agg(F.min("chunk").alias("since"))
    known = paths.join(earlier, ["owner", "path"]).filter("since < chunk")
    return handed.selectExpr("'state' AS what", "chunk", "owner", *_STATE, "CAST(NULL AS STRING) AS path").union(
        known.selectExpr(
            "'ignored'", "chunk", "owner", "CAST(NULL AS INT)", "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)",
            "CAST(NULL AS STRING)", "path",
        )
    )


def _outcomes(narrow: DataFrame, width: int) -> DataFrame:
    """``(owner, seq, outcome, tick_seq)`` of ticks and decisions."""
    steps = narrow.select(
        F.col("owner").cast("string").alias("owner"), F.col("seq").cast("long").alias("seq"), "kind", "choice", "path",
        "text_key", "is_empty", "too_large", (F.col("level") == "LOW").alias("is_low"),
    )
    rows = chunked(steps, ["owner"], "seq", width).withColumnRenamed("_chunk", "chunk")
    by_chunk = rows.groupBy("chunk")
    firsts = stage(by_chunk.agg(F.min("owner").alias("owner")))
    paths = stage(rows.filter("path <> ''").join(firsts, ["chunk", "owner"], "left_semi").select("chunk", "owner", "path").distinct())

    def run(chosen: DataFrame, given: DataFrame, outcomes: bool = False) -> DataFrame:
        return chosen.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(
            lambda a, b: run_chunk(a, b, outcomes), SAYS
        )

    given = stage(_given(rows.sparkSession.createDataFrame([], SAYS), firsts, paths))
    said = stage(run(rows, given))
    while True:
        after = stage(_given(said, firsts, paths))
        changed = stage(after.exceptAll(given).union(given.exceptAll(after)).select("chunk").distinct())
        if changed.isEmpty():
            return run(rows, given, outcomes=True).select("owner", "seq", "outcome", "tick_seq")
        given = after
        again = run(rows.join(changed, "chunk", "left_semi"), given.join(changed, "chunk", "left_semi"))
        said = stage(said.join(changed, "chunk", "left_anti").unionByName(again))


def _scanned(rows: DataFrame, rules, max_bytes: int, scan) -> DataFrame:
    good = good_rows(rows)
    return stage(scan(good) if scan else narrow_ticks(good, rules, max_bytes))


def monitor(
    rows: DataFrame,
    rules: Sequence[Rule] | None = None,
    max_bytes: int = MAX_TEXT_BYTES,
    width: int = DEFAULT_WIDTH,
    scan: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per tick with its ``outcome`` and, for alerts, the ``message``.

    In order: a tick with a suppression open is ``suppressed``; an empty text, or one
    equal to the remembered text, is ``unchanged``; then ``too_large``, ``ignored``,
    ``low``, ``alert``.  The remembered text is that of the last tick which was
    suppressed or not empty, or what a sanitize decision put in its place.  Numbers are
    unique within an owner.  ``scan`` takes the place of ``narrow_ticks``, as
    ``narrow_as_of`` for rules that change over time.
    """
    narrow = _scanned(rows, rules, max_bytes, scan)
    outcomes = _outcomes(narrow, width)
    ticks = narrow.filter("kind = 'tick'").join(outcomes.drop("tick_seq"), ["owner", "seq"])
    kept = [c for c in rows.columns if c not in ("text", "kind", "choice")]
    done = ticks.select(*kept, "score", "level", "findings", "outcome")
    message = warn_message(F.col("score"), F.col("level"), F.col("findings"))
    return done.select("*", F.when(F.col("outcome") == "alert", message).alias("message"))


def decisions(
    rows: DataFrame, rules: Sequence[Rule] | None = None, max_bytes: int = MAX_TEXT_BYTES, width: int = DEFAULT_WIDTH,
    scan: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(owner, seq, choice, outcome, tick_seq)`` of every decision.

    ``applied`` or ``refused``; ``tick_seq`` is the tick whose text is to be sanitized.
    Refused ones belong in the error table, beside ``bad_rows``.
    """
    narrow = _scanned(rows, rules, max_bytes, scan)
    asked = narrow.filter("kind = 'decision'").select("owner", "seq", "choice")
    return asked.join(_outcomes(narrow, width), ["owner", "seq"])


def changed_ticks(rows: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Ticks whose text is neither empty nor the one remembered, without scanning anything."""
    keyed = rows.select(
        "owner", "seq", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"),
        (F.coalesce("text", F.lit("")) == "").alias("is_empty"),
    )
    # Written once: cutting the rows into chunks reads them several times, texts only here.
    seen = prefix_scan(
        stage(keyed), ["owner"], "seq", lasts={"memory": "if(is_empty, NULL, text_key)"}, width=width
    )
    return seen.filter(
        f"NOT is_empty AND text_key <> coalesce(memory, {EMPTY_KEY})"
    ).select("owner", "seq")


def sanitized_texts(
    rows: DataFrame, rules: Sequence[Rule] | None = None, width: int = DEFAULT_WIDTH, decided: DataFrame | None = None
) -> DataFrame:
    """What each sanitize decision that counts puts in place of the text it answers.

    Only those texts are rewritten: their ticks are known by number first, and the texts
    joined to them.  ``decided`` has ``(owner, seq, tick_seq)``, as ``decisions`` or the
    stream gives it; without it the monitor is run.
    """
    decided = decisions(rows, rules, width=width) if decided is None else decided
    wanted = decided.filter("tick_seq IS NOT NULL").select(
        "owner", F.col("seq").alias("decision_seq"), F.col("tick_seq").alias("seq")
    )
    texts = rows.filter("kind = 'tick'").select("owner", "seq", "text")
    joined = texts.join(wanted, ["owner", "seq"])
    return joined.select("owner", "decision_seq", F.expr(sanitize(rules=rules)).alias("sanitized"))
