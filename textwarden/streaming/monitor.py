"""The text monitor as a stateful stream, and stateless scans of a stream.

Scanning runs as built-in expressions ahead of the state; the state step sees narrow
rows only, keyed by owner, and does nothing but bookkeeping.  State per owner is a
counter, a hash of the remembered text, the alert that waits for an answer, and the ignored
paths.  No text is part of it: a sanitize
decision gives the number of its tick, by which ``sanitized_texts`` finds the text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from textwarden.functions.risk import score_units
from textwarden.functions.rules import MAX_TEXT_BYTES, Rule
from textwarden.operators.monitor import good_rows, narrow_ticks
from textwarden.operators.rule_versions import RuleVersion, narrow_as_of
from textwarden.operators.ticks import State, Step, run_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how often the monitor looks.
POLL_INTERVAL = "200 milliseconds"

ROW_SCHEMA = (
    "owner STRING, seq BIGINT, ts TIMESTAMP, kind STRING, text STRING, path STRING, choice STRING"
)
_PARTITIONS = "spark.sql.shuffle.partitions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("findings", T.StringType()),
        T.StructField("tick_seq", T.LongType()),
    ]
)
_STATE = T.StructType(
    [
        T.StructField("opened", T.IntegerType()),
        T.StructField("memory", T.StringType()),
        T.StructField("alert_seq", T.LongType()),
        T.StructField("alert_path", T.StringType()),
    ]
)
_PATH = T.StructType([T.StructField("path", T.StringType())])
_SEEN = T.StructType([T.StructField("seen", T.BooleanType())])


class TickProcessor(StatefulProcessor):
    """Applies the rows of one owner in the order of their numbers."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _STATE, self.ttl_ms)
        self.ignored = handle.getMapState("ignored", _PATH, _SEEN, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("seq")
        batch = batch.astype(object).where(batch.notna(), None)
        state = State(*self.state.get()) if self.state.exists() else State()
        steps = list(map(Step, *(batch[c] for c in Step._fields)))
        # Asking the state store costs a round trip, so each path is asked for once.
        known = {}

        def is_ignored(path: str) -> bool:
            if path not in known:
                known[path] = self.ignored.containsKey((path,))
            return known[path]

        def ignore(path: str) -> None:
            known[path] = True
            self.ignored.updateValue((path,), (True,))

        state, done = run_rows(state, steps, is_ignored, ignore)
        self.state.update(tuple(state))
        shown = dict(zip(batch["seq"], batch[["ts", "score", "level", "findings"]].itertuples(index=False, name=None)))
        yield pd.DataFrame(
            [
                (key[0], r.seq, shown[r.seq][0], r.path, outcome, *shown[r.seq][1:], tick)
                for r, outcome, tick in done
            ],
            columns=_OUT.fieldNames(),
        ).astype({"tick_seq": "Int64"})

    def close(self) -> None:
        pass


def monitor_stream(
    rows: DataFrame,
    rules: Sequence[Rule] | None = None,
    max_bytes: int = MAX_TEXT_BYTES,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Outcomes of a stream of monitor rows; for a sanitize decision that counts, the tick it answers.

    ``ttl_ms`` forgets owners that have been silent for so long.  A micro-batch must
    follow the ones before it in ``seq``; rows within it may come in any order.
    """
    return monitor_narrow(_narrow(narrow_ticks(good_rows(rows), rules, max_bytes)), ttl_ms)


#: What the state step reads: rows whose text has been scanned and left behind.
NARROW_SCHEMA = (
    "owner STRING, seq BIGINT, ts TIMESTAMP, kind STRING, path STRING, choice STRING, text_key STRING, "
    "is_empty BOOLEAN, too_large BOOLEAN, is_low BOOLEAN, score DOUBLE, level STRING, findings STRING"
)


def _narrow(ticks: DataFrame) -> DataFrame:
    return ticks.select(
        "owner", "seq", "ts", "kind", "path", "choice", "text_key", "is_empty", "too_large",
        (F.col("level") == "LOW").alias("is_low"), F.col("score").cast("double").alias("score"), "level",
        F.array_join("findings", ", ").alias("findings"),
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state and timers need."""
    if _ROCKSDB not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def monitor_narrow(narrow: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The outcomes of a stream of rows of ``NARROW_SCHEMA``."""
    use_rocksdb(narrow.sparkSession)
    mode = "ProcessingTime" if ttl_ms else "None"
    return narrow.groupBy("owner").transformWithStateInPandas(TickProcessor(ttl_ms), _OUT, "Append", mode)


def scan_ticks(
    rows: DataFrame,
    load_versions: Callable[[SparkSession], Sequence[RuleVersion]],
    path: str,
    checkpoint: str,
    max_bytes: int = MAX_TEXT_BYTES,
    once: bool = False,
    poll: str = POLL_INTERVAL,
) -> StreamingQuery:
    """Scans a stream of monitor rows, with the rules read anew for every micro-batch.

    The narrow rows go to a folder for each batch, which a batch that is tried again
    replaces; ``read_narrow`` streams them on to ``monitor_narrow``.  Every row is scanned
    with the rules of its own time, so a version must be in the table before rows of that
    time arrive, and a batch tried again after the rules changed gives the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        done = _narrow(narrow_as_of(good_rows(batch), load_versions(batch.sparkSession), max_bytes))
        done.write.mode("overwrite").parquet(f"{path}/batch-{number}")

    timing = {"availableNow": True} if once else {"processingTime": poll}
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**timing).start()


def read_narrow(spark: SparkSession, path: str) -> DataFrame:
    """The rows ``scan_ticks`` wrote, as a stream."""
    return spark.readStream.schema(NARROW_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def stream_alerts(outcomes: DataFrame) -> DataFrame:
    """The alerts among the outcomes, with their warning."""
    message = F.format_string(
        "Risk %s/100 (%s) — %s", F.col("score").cast("int").cast("string"), "level", "findings"
    )
    return outcomes.filter("outcome = 'alert'").select(
        "owner", "seq", "ts", "path", "score", "level", message.alias("message")
    )


def alert_rate(alerts: DataFrame, length: str = "5 minutes", lateness: str | None = None) -> DataFrame:
    """Alerts per window and level.  On a stream, rows later than ``lateness`` are dropped."""
    if lateness:
        alerts = alerts.withWatermark("ts", lateness)
    return alerts.groupBy(F.window("ts", length).alias("span"), "level").agg(
        F.count("*").alias("alerts")
    ).select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
        "level", "alerts",
    )


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    poll: str = POLL_INTERVAL,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Appends a stream to parquet; ``once`` works off what is there and stops.

    ``state_partitions`` is how many parts the state is kept in; it holds for the life of
    the checkpoint, so it should suit the owners expected, not those of the first day.
    """
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    timing = {"availableNow": True} if once else {"processingTime": poll}
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_PARTITIONS)
    conf.set(_PARTITIONS, str(state_partitions or before))
    try:
        return writer.trigger(**timing).start()
    finally:
        conf.set(_PARTITIONS, before)


def scan_stream(
    units: DataFrame,
    load_rules: Callable[[SparkSession], Sequence[Rule]],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    path: str | None = None,
    once: bool = False,
    poll: str = POLL_INTERVAL,
) -> StreamingQuery:
    """Scores a stream, reading the rules anew for every micro-batch.

    ``write`` gets the scored rows and the batch number; a batch that is tried again
    comes with the same number, so the sink can tell.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(score_units(batch, load_rules(batch.sparkSession), path=path), number)

    timing = {"availableNow": True} if once else {"processingTime": poll}
    return (
        units.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**timing)
        .start()
    )
