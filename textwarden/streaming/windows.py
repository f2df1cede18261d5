"""Alerts per window on a stream, with nothing lost: late rows are counted, open windows can be read.

A built-in windowed aggregate drops rows behind the watermark without a word and never
shows the windows the watermark has not passed.  Here a run of neighbouring windows is a key
with their counters and an event-time timer for the first that is open.  When the watermark
reaches the window's end, the timer writes every window that has ended, forgets it, and is set
for the next; alerts that come after that leave as rows of kind ``late``.
``open_windows`` reads from the checkpoint what is still counted.  So every alert is in
exactly one of three places: a closed window, a late row, or an open window.

Alerts are added up per task before they are shuffled, so a window with a third of all
rows sends one row per task and level.  State per key is one number for each of at most
``RUN`` windows and the levels met in them; a batch reads and writes it once, since each
call to the state store costs a round trip.

Defined results: alerts without a time belong to no window and are left out; a null level
is a level; an empty stream gives no rows.  A late alert never opens its window again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textwarden.streaming.monitor import use_rocksdb

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Windows that share a key, its state and its timer.
RUN = 64

_WINDOW = ["start_ms", "end_ms", "level"]
_COUNTED = "start_ms: LONG, end_ms: LONG, level: STRING, alerts: LONG"
_PARTIAL = "start_ms LONG, end_ms LONG, level STRING, alerts LONG"
_OUT = "kind STRING, start_ms LONG, end_ms LONG, level STRING, alerts LONG"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's alerts by window and level."""
    sums: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).append_column("alerts", pa.array([1] * batch.num_rows, pa.int64()))
        rows = rows if sums is None else pa.concat_tables([sums, rows])
        sums = rows.group_by(_WINDOW).aggregate([("alerts", "sum")]).rename_columns({"alerts_sum": "alerts"})
        sums = sums.select([*_WINDOW, "alerts"])
    if sums is not None:
        yield from sums.to_batches()


class WindowProcessor(StatefulProcessor):
    """Counts the levels of a run of windows, each until the watermark has passed its end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("alerts", f"counts ARRAY<STRUCT<{_COUNTED}>>")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        late, came = {}, {}
        for part in rows:
            for start, end, level, alerts in zip(*(part[c].tolist() for c in (*_WINDOW, "alerts"))):
                into = late if end <= mark else came
                window = (start, end, level if isinstance(level, str) else None)
                into[window] = into.get(window, 0) + alerts
        if came:
            held = self._held()
            before = self._next_end(held)
            for window, alerts in came.items():
                held[window] = held.get(window, 0) + alerts
            self._keep(held, before)
        if late:
            yield self._rows("late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        done = {window: alerts for window, alerts in held.items() if window[1] <= mark}
        if done:
            self._keep({window: alerts for window, alerts in held.items() if window not in done}, None)
            yield self._rows("window", done)

    def _held(self) -> dict[tuple, int]:
        if not self.counts.exists():
            return {}
        return {tuple(row[:3]): row[3] for row in self.counts.get()[0]}

    @staticmethod
    def _next_end(held: dict[tuple, int]) -> int | None:
        return min((window[1] for window in held), default=None)

    def _keep(self, held: dict[tuple, int], before: int | None) -> None:
        """Stores the counters; sets the timer unless it stands at ``before``, the first end."""
        if not held:
            self.counts.clear()
            return
        first = self._next_end(held)
        if first != before:
            # A timer fires once the watermark is beyond it.
            self.handle.registerTimer(first - 1)
        self.counts.update(([(*window, alerts) for window, alerts in held.items()],))

    @staticmethod
    def _rows(kind: str, counts: dict[tuple, int]) -> pd.DataFrame:
        return pd.DataFrame([(kind, *window, n) for window, n in counts.items()], columns=["kind", *_WINDOW, "alerts"])

    def close(self) -> None:
        pass


def _named(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(
        *first, F.timestamp_millis("start_ms").alias("window_start"), F.timestamp_millis("end_ms").alias("window_end"),
        "level", "alerts",
    )


def alert_windows(alerts: DataFrame, length: str = "5 minutes", lateness: str | None = None) -> DataFrame:
    """``(kind, window_start, window_end, level, alerts)`` of a stream: closed windows and late rows.

    ``lateness`` sets the watermark on the alerts.  A stream that has one already, on all
    rows the alerts were chosen from, passes none: then windows close when no alerts come.
    """
    use_rocksdb(alerts.sparkSession)
    if lateness:
        alerts = alerts.withWatermark("ts", lateness)
    # Computed from the time, not the time itself, or Spark would drop late rows before the state step.
    span = F.window(F.timestamp_millis(F.unix_millis("ts")), length)
    timed = alerts.filter(F.col("ts").isNotNull()).withColumn("_span", span).select(
        F.unix_millis("_span.start").alias("start_ms"), F.unix_millis("_span.end").alias("end_ms"), "level"
    )
    sums = timed.mapInArrow(_partial, _PARTIAL)
    run = F.floor(F.col("start_ms") / ((F.col("end_ms") - F.col("start_ms")) * RUN)).alias("run")
    done = sums.select("*", run).groupBy("run").transformWithStateInPandas(WindowProcessor(), _OUT, "Append", "EventTime")
    return _named(done, "kind")


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(window_start, window_end, level, alerts)`` that a stream's last batch left open."""
    state = spark.read.format("statestore").option("stateVarName", "alerts").load(checkpoint)
    return _named(state.select(F.inline("value.counts")))
