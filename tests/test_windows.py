from datetime import datetime, timedelta

from textwarden.streaming.monitor import write_stream
from textwarden.streaming.windows import alert_windows, open_windows

ZERO = datetime(2024, 1, 1)
KIND = "ts TIMESTAMP, level STRING"


def _minute(m):
    return None if m is None else ZERO + timedelta(minutes=m)


def _plain(deliveries, lateness=10, length=5):
    """Closed, late and open counts, by a loop over deliveries."""
    mark, counts, closed, late = None, {}, {}, {}
    for rows in deliveries:
        for m, level in rows:
            if m is None:
                continue
            key = (m // length * length, level)
            into = late if mark is not None and key[0] + length <= mark else counts
            into[key] = into.get(key, 0) + 1
        times = [m for m, _ in rows if m is not None]
        if times:
            mark = max(times) - lateness if mark is None else max(mark, max(times) - lateness)
        for key in [k for k in counts if mark is not None and k[0] + length <= mark]:
            closed[key] = counts.pop(key)
    return closed, late, counts


def _run(spark, folder, deliveries):
    for rows in deliveries:
        batch = spark.createDataFrame([(_minute(m), level) for m, level in rows], KIND)
        batch.repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{folder}/in")
        write_stream(
            alert_windows(stream, lateness="10 minutes"), f"{folder}/out", f"{folder}/state", once=True, state_partitions=3
        ).awaitTermination()

    def found(rows):
        out = {}
        for r in rows.collect():
            assert r.window_end - r.window_start == timedelta(minutes=5)
            key = (int((r.window_start - ZERO).total_seconds()) // 60, r.level)
            out[key] = out.get(key, 0) + r.alerts
        return out

    done = spark.read.parquet(f"{folder}/out")
    return found(done.filter("kind = 'window'")), found(done.filter("kind = 'late'")), found(open_windows(spark, f"{folder}/state"))


def test_late_rows_are_counted_and_open_windows_read(spark, tmp_path):
    deliveries = [
        [(0, "HIGH"), (1, "HIGH"), (4, None), (7, "MEDIUM"), (21, "HIGH"), (None, "HIGH")],
        [(2, "HIGH"), (3, "MEDIUM"), (8, "MEDIUM"), (12, "HIGH"), (13, "HIGH"), (22, "HIGH"), (40, "HIGH")],
        [(0, "HIGH"), (29, "HIGH"), (30, "HIGH"), (41, "MEDIUM"), (12, "HIGH")],
    ]
    got = _run(spark, tmp_path, deliveries)
    assert got == _plain(deliveries)
    assert all(got) and sum(sum(part.values()) for part in got) == 17


def test_a_stream_without_alerts(spark, tmp_path):
    assert _run(spark, tmp_path, [[(None, "HIGH")]]) == ({}, {}, {})


def test_neighbouring_windows_share_a_key(spark, tmp_path):
    minutes = [*range(0, 900, 2), *range(2000, 2900, 3)]
    deliveries = [
        [(m, level) for m in minutes for level in ("HIGH", None)],
        [(m, "MEDIUM") for m in (1, 1990, 2891, 2950)],
        [(m, "HIGH") for m in (2895, 2899, 3, 3100, 3407)],
        [(m, "HIGH") for m in (3100, 3398, 3500)],
    ]
    for n in (1, 4):
        folder = tmp_path / str(n)
        got = _run(spark, folder, deliveries[:n])
        assert got == _plain(deliveries[:n])
        if n == 1:
            # The last windows are open: one state for all, and read one by one.
            state = spark.read.format("statestore").option("stateVarName", "alerts").load(f"{folder}/state")
            assert len(got[2]) == 6 and state.count() == 1
