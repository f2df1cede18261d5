"""Registered queries: the monitor over ticks derived from the tables."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.risk import score_units
from textwarden.functions.rules import BUILTIN_COUNT, Rule, builtin_rules
from textwarden.operators.monitor import (
    bad_rows, changed_ticks, decisions, good_rows, monitor, sanitized_texts,
)
from textwarden.operators.rule_versions import narrow_as_of, rule_versions
from textwarden.operators.staging import shared_folder
from textwarden.plans import sql
from textwarden.plans.fixtures import PLANTED_SQL, SAMPLES, pick, pick_sql, planted
from textwarden.plans.registry import Query
from textwarden.sources.corpus import scan_corpus
from textwarden.streaming.monitor import (
    alert_rate, monitor_narrow, monitor_stream, read_narrow, scan_stream, scan_ticks, stream_alerts, write_stream,
)
from textwarden.streaming.windows import alert_windows, open_windows
from textwarden.sources.rule_files import RAW_COLUMNS

QUERIES: dict[str, Query] = {}

WIDTH = 2_000
START = "2024-01-01 00:00:00"

# Every document is looked at twice by the owner named by its source, sometimes followed
# by an empty text; some looks are preceded by a suppression or followed by a decision,
# whether they alerted or not.
_EVENTS = """
    named_struct('step', 0, 'kind', 'suppress', 'used', doc_id % 11 = 0),
    named_struct('step', 1, 'kind', 'tick', 'used', true),
    named_struct('step', 2, 'kind', 'decision', 'used', doc_id % 5 = 0),
    named_struct('step', 3, 'kind', 'tick', 'used', true),
    named_struct('step', 4, 'kind', 'empty', 'used', doc_id % 4 = 0),
    named_struct('step', 5, 'kind', 'tick', 'used', doc_id % 8 = 0)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).select(
        "doc_id", F.col("source").alias("owner"), "path", "text",
        F.expr(f"inline(filter(array({_EVENTS}), e -> e.used))"),
    )
    return rows.selectExpr(
        "owner",
        "doc_id * 10 + step AS seq",
        f"timestamp_ntz '{START}' + make_dt_interval(0, 0, 0, doc_id * 10 + step) AS ts",
        "if(kind = 'empty', 'tick', kind) AS kind",
        "CASE kind WHEN 'tick' THEN text WHEN 'empty' THEN '' END AS text",
        "path",
        "CASE WHEN kind = 'decision' THEN element_at(array('sanitize', 'ignore', 'allow'), "
        "int(doc_id div 5 % 3) + 1) END AS choice",
    )


_TICKS_SQL = f"""
    docs AS ({PLANTED_SQL}),
    events AS (
      SELECT d.*, e.step, e.kind AS what FROM docs d, (VALUES (0, 'suppress'), (1, 'tick'),
        (2, 'decision'), (3, 'tick'), (4, 'empty'), (5, 'tick')) e(step, kind)
      WHERE CASE e.step WHEN 0 THEN doc_id % 11 = 0 WHEN 2 THEN doc_id % 5 = 0
        WHEN 4 THEN doc_id % 4 = 0 WHEN 5 THEN doc_id % 8 = 0 ELSE true END),
    ticks AS (
      SELECT source AS owner, doc_id * 10 + step AS seq,
        TIMESTAMP '{START}' + to_seconds(doc_id * 10 + step) AS ts,
        CASE WHEN what = 'empty' THEN 'tick' ELSE what END AS kind,
        CASE what WHEN 'tick' THEN text WHEN 'empty' THEN '' END AS text, path,
        CASE WHEN what = 'decision' THEN
          (['sanitize', 'ignore', 'allow'])[(doc_id // 5) % 3 + 1] END AS choice
      FROM events)"""

_MONITOR_SQL = f"""
    WITH RECURSIVE {_TICKS_SQL},
    {sql.scored("SELECT doc_id, path, text FROM docs")},
    cleaned AS (SELECT *, {sql.rewrite('text')} AS clean FROM risk),
    rows AS (
      SELECT t.*, CASE WHEN t.text = '' THEN '' ELSE c.clean END AS clean,
        CASE WHEN t.text = '' THEN 0 ELSE c.score END AS score,
        CASE WHEN t.text = '' THEN 'LOW' ELSE c.level END AS level,
        CASE WHEN t.text = '' THEN '' ELSE c.findings END AS findings
      FROM ticks t LEFT JOIN cleaned c ON t.kind = 'tick' AND t.seq // 10 = c.doc_id),
    numbered AS MATERIALIZED (
      SELECT owner, seq, ts, kind, choice, path, score, level, findings, md5(text) AS own, md5(clean) AS cleaned,
        strlen(text) > 204800 AS big, row_number() OVER (PARTITION BY owner ORDER BY seq) AS rn FROM rows),
    -- One row of every owner after the other: the state after it, and its outcome.
    run AS (
      SELECT DISTINCT owner, CAST(0 AS BIGINT) AS rn, 0 AS opened, md5('') AS memory, CAST(NULL AS BIGINT) AS alert_seq,
        CAST(NULL AS VARCHAR) AS alert_path, CAST(NULL AS VARCHAR) AS alert_clean, CAST([] AS VARCHAR[]) AS ignored,
        CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS tick_seq FROM numbered
      UNION ALL
      SELECT owner, rn,
        CASE WHEN kind = 'suppress' OR (o = 'applied' AND choice = 'sanitize') THEN opened + 1
          WHEN o = 'suppressed' THEN opened - 1 ELSE opened END,
        CASE WHEN o = 'applied' AND choice = 'sanitize' THEN alert_clean
          WHEN kind = 'tick' AND (o = 'suppressed' OR own <> md5('')) THEN own ELSE memory END,
        CASE WHEN kind = 'suppress' THEN alert_seq WHEN o = 'alert' THEN seq END,
        CASE WHEN kind = 'suppress' THEN alert_path WHEN o = 'alert' THEN path END,
        CASE WHEN kind = 'suppress' THEN alert_clean WHEN o = 'alert' THEN cleaned END,
        CASE WHEN o = 'applied' AND choice = 'ignore' AND alert_path <> '' THEN list_append(ignored, alert_path)
          ELSE ignored END,
        o, CASE WHEN o = 'applied' AND choice = 'sanitize' THEN alert_seq END
      FROM (
        SELECT n.*, r.opened, r.memory, r.alert_seq, r.alert_path, r.alert_clean, r.ignored,
          CASE WHEN n.kind = 'suppress' THEN NULL
            WHEN n.kind = 'decision' THEN CASE WHEN r.alert_seq IS NULL THEN 'refused' ELSE 'applied' END
            WHEN r.opened > 0 THEN 'suppressed' WHEN n.own = md5('') OR n.own = r.memory THEN 'unchanged'
            WHEN n.big THEN 'too_large' WHEN list_contains(r.ignored, n.path) THEN 'ignored'
            WHEN n.level = 'LOW' THEN 'low' ELSE 'alert' END AS o
        FROM run r JOIN numbered n ON n.owner = r.owner AND n.rn = r.rn + 1)),
    done AS (SELECT n.*, r.outcome, r.tick_seq FROM run r JOIN numbered n ON n.owner = r.owner AND n.rn = r.rn),
    outcomes AS (SELECT * FROM done WHERE kind = 'tick')"""


def _outcomes(spark, sf_dir):
    rows = monitor(ticks(spark, sf_dir), width=WIDTH)
    return rows.select("owner", "seq", "outcome")


QUERIES["monitor_outcomes"] = Query(
    _outcomes, _MONITOR_SQL + " SELECT owner, seq, outcome FROM outcomes"
)


def _alerts(spark, sf_dir):
    rows = monitor(ticks(spark, sf_dir), width=WIDTH)
    return rows.filter("outcome = 'alert'").select("owner", "seq", "message")


QUERIES["monitor_alerts"] = Query(
    _alerts,
    _MONITOR_SQL + " SELECT owner, seq, 'Risk ' || score || '/100 (' || level || ') — ' || findings "
    "AS message FROM outcomes WHERE outcome = 'alert'",
)


def _rate(spark, sf_dir):
    rows = monitor(ticks(spark, sf_dir), width=WIDTH)
    rate = alert_rate(rows.filter("outcome = 'alert'"))
    return rate.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "alerts"
    )


QUERIES["alert_rate_window"] = Query(
    _rate,
    _MONITOR_SQL + " SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') "
    "AS window_start, level, count(*) AS alerts FROM outcomes WHERE outcome = 'alert' GROUP BY ALL",
)


def _sanitized(spark, sf_dir):
    done = sanitized_texts(ticks(spark, sf_dir), width=WIDTH)
    return done.select("owner", "decision_seq", F.md5("sanitized").alias("sanitized_md5"))


QUERIES["monitor_sanitized"] = Query(
    _sanitized,
    _MONITOR_SQL + " SELECT d.owner, d.seq AS decision_seq, t.cleaned AS sanitized_md5 "
    "FROM done d JOIN numbered t ON t.owner = d.owner AND t.seq = d.tick_seq",
)


def _decisions(spark, sf_dir):
    """Which decisions answer an alert, and which are refused."""
    return decisions(ticks(spark, sf_dir), width=WIDTH).select("owner", "seq", "choice", "outcome")


QUERIES["monitor_decisions"] = Query(
    _decisions, _MONITOR_SQL + " SELECT owner, seq, choice, outcome FROM done WHERE kind = 'decision'"
)


# The rules change twice while the ticks come in: the documents from which a rule is added,
# and the rule; the second version has no longer the rule of the first.
CHANGES = (
    (70, Rule(BUILTIN_COUNT, "openings", "Opening", r"\bth[aeo]n?\s+(?:re|an)\w*", "gi", "<OPENING>", 45.0, False)),
    (140, Rule(BUILTIN_COUNT, "endings", "Ending", r"\b\w+(?:tion|ci\u00f3n|ung)\s", "g", "<ENDING>", 70.0, True)),
)


def _changed_definitions(spark, changes=CHANGES):
    """The versions as a table of definitions; every list holds from a time on."""
    rows = [
        (f"{START[:10]}T{since * 10 // 3600:02d}:{since * 10 // 60 % 60:02d}:{since * 10 % 60:02d}", None, 0, None, 0,
         r.id, r.label, r.regex, r.flags, r.placeholder, float(r.risk), r.critical, True)
        for since, r in changes
    ]
    types = "string, string, int, string, int, string, string, string, string, string, double, boolean, boolean".split(", ")
    schema = ", ".join(f"{c} {t}" for c, t in zip(["since", *RAW_COLUMNS], types))
    return spark.createDataFrame(rows, schema).withColumn("since", F.to_timestamp("since"))


def _changing_ticks(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _if_alert(findings):
    alert = F.col("outcome") == "alert"
    return [
        F.when(alert, F.col("score").cast("bigint")).otherwise(0).alias("score"),
        F.when(alert, findings).otherwise("").alias("findings"),
    ]


def _rule_changes(spark, sf_dir):
    versions = rule_versions(_changed_definitions(spark))
    rows = monitor(_changing_ticks(spark, sf_dir), width=WIDTH, scan=lambda r: narrow_as_of(r, versions))
    return rows.select("owner", "seq", "outcome", *_if_alert(F.array_join("findings", ", ")))


_ALL_RULES = (*builtin_rules(), *(replace(r, ord=BUILTIN_COUNT + k) for k, (_, r) in enumerate(CHANGES)))
_HOLDS = f"(doc_id >= {CHANGES[0][0]} AND doc_id < {CHANGES[1][0]} AND ord = {BUILTIN_COUNT}) OR (doc_id >= {CHANGES[1][0]} AND ord = {BUILTIN_COUNT + 1})"
_RULE_CHANGES_SQL = (
    _MONITOR_SQL.replace(
        sql.scored("SELECT doc_id, path, text FROM docs"),
        sql.scored("SELECT doc_id, path, text FROM docs", rules=_ALL_RULES).replace(
            "WHERE ord IS NOT NULL", f"WHERE ord < {BUILTIN_COUNT} OR {_HOLDS}"
        ),
    ).replace(
        sql.rewrite("text") + " AS clean",
        f"CASE WHEN doc_id < {CHANGES[0][0]} THEN {sql.rewrite('text')} WHEN doc_id < {CHANGES[1][0]} "
        f"THEN {sql.rewrite('text', _ALL_RULES[:-1])} ELSE {sql.rewrite('text', (*builtin_rules(), _ALL_RULES[-1]))} END AS clean",
    )
    + " SELECT owner, seq, outcome, CASE WHEN outcome = 'alert' THEN score ELSE 0 END AS score, "
    "CASE WHEN outcome = 'alert' THEN findings ELSE '' END AS findings FROM outcomes"
)
QUERIES["monitor_rule_changes"] = Query(_rule_changes, _RULE_CHANGES_SQL)


def _conversation_ticks(spark, sf_dir):
    rows = scan_corpus(spark, f"{sf_dir}/conversations.parquet", ("conv_id", "turn", "role", "text"))
    # Assistant turns repeat the user's text with its sample, so that texts stay the same.
    return rows.select(
        F.col("conv_id").alias("owner"), F.col("turn").alias("seq"),
        F.concat_ws(" ", F.when(F.col("role") != "assistant", F.col("text")),
                    pick(SAMPLES, "conv_id")).alias("text"),
    )


def _changes(spark, sf_dir):
    return changed_ticks(_conversation_ticks(spark, sf_dir))


QUERIES["monitor_changes"] = Query(
    _changes,
    f"""WITH ticks AS (SELECT conv_id AS owner, turn AS seq, concat_ws(' ',
      CASE WHEN role <> 'assistant' THEN text END, {pick_sql(SAMPLES, 'conv_id')}) AS text
      FROM conversations), seen AS (SELECT *, coalesce(last_value(nullif(text, '') IGNORE NULLS)
      OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
      AS memory FROM ticks)
    SELECT owner, seq FROM seen WHERE text <> '' AND text <> memory""",
)


def _whole_turns(spark, sf_dir):
    rows = scan_corpus(spark, f"{sf_dir}/conversations.parquet", ("conv_id", "turn", "role", "text"))
    rows = rows.select(F.col("conv_id").alias("owner"), (2 * F.col("turn")).alias("seq"), "text")
    # Every third turn comes again at the next number, so that texts stay the same.
    return rows.union(rows.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 1))


def _whole_changes(spark, sf_dir):
    return changed_ticks(_whole_turns(spark, sf_dir))


QUERIES["monitor_changes_whole"] = Query(
    _whole_changes,
    """WITH turns AS (SELECT conv_id AS owner, 2 * turn AS seq, text FROM conversations),
    ticks AS (SELECT * FROM turns UNION ALL SELECT owner, seq + 1, text FROM turns WHERE seq % 3 = 0),
    seen AS (SELECT *, coalesce(last_value(nullif(text, '') IGNORE NULLS)
      OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
      AS memory FROM ticks)
    SELECT owner, seq FROM seen WHERE text <> '' AND text <> memory""",
)


def _broken(spark, sf_dir):
    """Rows with a missing owner or an unknown kind, planted among the ticks."""
    rows = ticks(spark, sf_dir).withColumns(
        {
            "owner": F.expr("if(seq % 70 = 1, NULL, owner)"),
            "kind": F.expr("if(seq % 110 = 1, 'other', kind)"),
        }
    )
    return (
        bad_rows(rows).groupBy("reason").count()
        .union(good_rows(rows).groupBy(F.lit("good").alias("reason")).count())
        .withColumnRenamed("count", "rows_seen")
    )


QUERIES["monitor_error_rows"] = Query(
    _broken,
    f"""WITH {_TICKS_SQL}, marked AS (SELECT CASE WHEN seq % 70 = 1 THEN 'no owner'
      WHEN seq % 110 = 1 THEN 'unknown kind' ELSE 'good' END AS reason FROM ticks)
    SELECT reason, count(*) AS rows_seen FROM marked GROUP BY reason""",
)


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _run_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _stream_source(spark, sf_dir, table):
    """A table as a stream, whether it is one file or a folder of files; a pattern takes both."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _streamed(spark, sf_dir):
    """The ticks in two deliveries; the stream is started again for the second and goes on
    from its state."""
    folder = _run_folder(spark, "ticks")
    rows = ticks(spark, sf_dir)
    highest = rows.agg(F.max("seq")).first()[0] or 0
    bounds = [0, highest // 2, highest + 1]
    for low, high in zip(bounds, bounds[1:]):
        part = rows.filter((F.col("seq") >= low) & (F.col("seq") < high))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        outcomes = monitor_stream(stream)
        write_stream(
            outcomes, f"{folder}/out", f"{folder}/state", once=True, state_partitions=_cores(spark)
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _streamed_outcomes(spark, sf_dir):
    outcomes = _streamed(spark, sf_dir).filter("outcome NOT IN ('applied', 'refused')")
    alerts = stream_alerts(outcomes).select("owner", "seq", "message")
    return outcomes.select("owner", "seq", "outcome").join(alerts, ["owner", "seq"], "left").select(
        "owner", "seq", "outcome", F.coalesce("message", F.lit("")).alias("message")
    )


QUERIES["stream_monitor"] = Query(
    _streamed_outcomes,
    _MONITOR_SQL + " SELECT owner, seq, outcome, CASE WHEN outcome = 'alert' THEN 'Risk ' || score "
    "|| '/100 (' || level || ') — ' || findings ELSE '' END AS message FROM outcomes",
)


def _streamed_rule_changes(spark, sf_dir):
    """The ticks in two deliveries; the second version of the rules is known only after the first."""
    folder = _run_folder(spark, "rule-changes")
    rows = _changing_ticks(spark, sf_dir)
    cut = CHANGES[1][0] * 10
    for known, part in ((CHANGES[:1], F.col("seq") < cut), (CHANGES, F.col("seq") >= cut)):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        definitions = _changed_definitions(spark, known)
        definitions.write.mode("overwrite").parquet(f"{folder}/rules-{len(known)}")
        rules = f"{folder}/rules-{len(known)}"
        scan_ticks(
            spark.readStream.schema(rows.schema).parquet(f"{folder}/in"),
            lambda session, rules=rules: rule_versions(session.read.parquet(rules)),
            f"{folder}/narrow", f"{folder}/scanned", once=True,
        ).awaitTermination()
        write_stream(
            monitor_narrow(read_narrow(spark, f"{folder}/narrow")), f"{folder}/out", f"{folder}/state", once=True,
            state_partitions=_cores(spark),
        ).awaitTermination()
    outcomes = spark.read.parquet(f"{folder}/out").filter("outcome NOT IN ('applied', 'refused')")
    return outcomes.select("owner", "seq", "outcome", *_if_alert(F.col("findings")))


QUERIES["stream_rule_changes"] = Query(_streamed_rule_changes, _RULE_CHANGES_SQL)


def _streamed_scan(spark, sf_dir):
    """Pages scored as a stream whose rules are read again for every micro-batch."""
    folder = _run_folder(spark, "pages")
    pages = _stream_source(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "html AS text")

    def write(scored: DataFrame, number: int) -> None:
        kept = scored.select("doc_id", "score", "level")
        kept.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = scan_stream(pages, lambda session: builtin_rules(), write, f"{folder}/state", once=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id", F.col("score").cast("bigint").alias("score"), "level"
    )


QUERIES["stream_scan_pages"] = Query(
    _streamed_scan,
    f"WITH {sql.scored('SELECT page_id AS doc_id, html AS text FROM pages', path=None)} "
    "SELECT doc_id, score, level FROM risk",
)


def _streamed_rate(spark, sf_dir):
    """Scored events per window on a stream, late rows dropped by the watermark."""
    folder = _run_folder(spark, "rate")
    rows = planted(spark, sf_dir).selectExpr(
        "doc_id", "path", "text",
        f"timestamp_ntz '{START}' + make_dt_interval(0, 0, 0, doc_id * 10) AS ts",
    )
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    alerts = score_units(stream, path="path").filter("level <> 'LOW'")
    rate = alert_rate(
        alerts.withColumn("ts", F.col("ts").cast("timestamp")), lateness="10 minutes"
    )
    write_stream(
        rate, f"{folder}/out", f"{folder}/state", once=True, state_partitions=_cores(spark)
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "alerts"
    )


# A window is written once the watermark, ten minutes behind the last alert, has passed it.
QUERIES["stream_alert_rate"] = Query(
    _streamed_rate,
    f"""WITH {sql.scored(PLANTED_SQL)}, alerts AS (
      SELECT level, TIMESTAMP '{START}' + to_seconds(doc_id * 10) AS ts FROM risk WHERE level <> 'LOW'),
    rate AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, level, count(*) AS alerts FROM alerts GROUP BY ALL)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, level, alerts FROM rate
    WHERE w + INTERVAL '5 minutes' <= (SELECT max(ts) FROM alerts) - INTERVAL '10 minutes'""",
)


def _streamed_windows(spark, sf_dir):
    """Alerts per window of a stream in three deliveries, the last one of rows that come late.

    Windows the watermark closed and windows still open are added up; late alerts stand beside them.
    """
    folder = _run_folder(spark, "windows")
    rows = planted(spark, sf_dir).selectExpr(
        "doc_id", "path", "text", f"timestamp_ntz '{START}' + make_dt_interval(0, 0, 0, doc_id * 10) AS ts"
    )
    half = (rows.agg(F.max("doc_id")).first()[0] or 0) // 2
    held, early = F.col("doc_id") % 13 == 5, F.col("doc_id") < half
    for part in (~held & early, ~held & ~early, held):
        # Small row groups, so that a stream splits a large file evenly over its tasks.
        rows.filter(part).write.mode("append").option("parquet.block.size", 4 << 20).parquet(f"{folder}/in")
        # The watermark is that of all rows, so windows close whether rows alert or not.
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).withWatermark("ts", "10 minutes")
        alerts = score_units(stream, path="path").filter("level <> 'LOW'")
        write_stream(
            alert_windows(alerts), f"{folder}/out", f"{folder}/state", once=True, state_partitions=_cores(spark)
        ).awaitTermination()
    still = open_windows(spark, f"{folder}/state").withColumn("kind", F.lit("window"))
    found = spark.read.parquet(f"{folder}/out").unionByName(still)

    def total(kind):
        return F.sum(F.when(F.col("kind") == kind, F.col("alerts")).otherwise(0)).cast("bigint")

    return found.groupBy("window_start", "level").agg(total("window").alias("alerts"), total("late").alias("late")).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "alerts", "late"
    )


# An alert is late if the watermark of the deliveries before its own has passed its window.
QUERIES["stream_alert_windows"] = Query(
    _streamed_windows,
    f"""WITH {sql.scored(PLANTED_SQL)}, dealt AS (
      SELECT level, TIMESTAMP '{START}' + to_seconds(doc_id * 10) AS ts,
             CASE WHEN doc_id % 13 = 5 THEN 3 WHEN doc_id < (SELECT max(doc_id) // 2 FROM risk) THEN 1 ELSE 2 END AS delivery
      FROM risk),
    marks AS (
      SELECT n AS delivery, (SELECT max(ts) FROM dealt WHERE dealt.delivery < n) - INTERVAL '10 minutes' AS mark
      FROM range(1, 4) AS t(n)),
    alerts AS (
      SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, level,
             coalesce(time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= mark, false) AS is_late
      FROM dealt JOIN marks USING (delivery) WHERE level <> 'LOW')
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, level,
           count(*) FILTER (NOT is_late) AS alerts, count(*) FILTER (is_late) AS late
    FROM alerts GROUP BY ALL""",
)
