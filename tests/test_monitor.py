import random

import pytest
from pyspark.sql import functions as F

from textwarden.operators.monitor import bad_rows, changed_ticks, decisions, monitor, sanitized_texts
from textwarden.operators.prefix import prefix_scan
from textwarden.streaming.monitor import (
    ROW_SCHEMA, alert_rate, monitor_stream, scan_stream, stream_alerts, write_stream,
)

K1, K2, K3 = (f"sk-{c * 20}" for c in "ABC")
AWS, MAIL = "AKIA" + "7QX2" * 4, "it@dept.gov"
S, IGN, SAN, ALLOW = ("suppress",), ("ignore",), ("sanitize",), ("allow",)

# (steps, texts alerted on); a step is a text, a (text, path), or a control.
SEQUENCES = [
    ([S, K1, K2], [K2]),
    ([S, S, K1, K2, K3], [K3]),
    ([(K1, "/f"), IGN, (AWS, "/f")], [K1]),
    ([(K1, "/f"), IGN, (AWS, "/g")], [K1, AWS]),
    ([K1, IGN, AWS], [K1, AWS]),
    ([K1, K1], [K1]),
    ([""], []),
    ([MAIL], []),
    ([K1, K2, K1], [K1, K2, K1]),
    ([K1, "", K1], [K1]),
    ([K1, S, "", K1], [K1, K1]),
    ([K1, SAN, "<API_KEY>", K1], [K1, K1]),
    ([K1, SAN, K2, K2], [K1]),
    ([K1, MAIL, K1], [K1, K1]),
    ([K1, ALLOW, K1], [K1]),
    ([("x" * 300 + K1, None), K1], [K1]),
    # Decisions without an alert to answer change nothing.
    ([SAN, K1], [K1]),
    ([MAIL, SAN, K1, K2], [K1, K2]),
    ([K1, K1, SAN, K2], [K1, K2]),
    ([K1, "", SAN, K2], [K1, K2]),
    ([S, K1, SAN, K2], [K2]),
    ([(K1, "/f"), ALLOW, IGN, (AWS, "/f")], [K1, AWS]),
    ([(K1, "/f"), IGN, (AWS, "/f"), SAN, (K2, "/g")], [K1, K2]),
    # Low, then "sanitize", then a secret: nothing may hide it.
    (["plain", SAN, AWS], [AWS]),
    ([K1, S, SAN, K2, K3, AWS], [K1, AWS]),
]
LIMIT = 200


def rows_of(owner, steps):
    out = []
    for i, step in enumerate(steps):
        if step in (S,):
            out.append((owner, i, "suppress", None, None, None))
        elif step in (IGN, SAN, ALLOW):
            out.append((owner, i, "decision", None, None, step[0]))
        else:
            text, path = step if isinstance(step, tuple) else (step, None)
            out.append((owner, i, "tick", text, path, None))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "owner STRING, seq BIGINT, kind STRING, text STRING, path STRING, choice STRING")
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))
    return df.select("owner", "seq", stamp.alias("ts"), "kind", "text", "path", "choice")


def model(rows):
    """What a plain loop over each owner's rows says."""
    clean = {K1: "<API_KEY>", K2: "<API_KEY>", K3: "<API_KEY>", AWS: "<AWS_KEY>", MAIL: "<EMAIL>"}
    state, out = {}, {}
    for owner, seq, kind, text, path, choice in sorted(rows, key=lambda r: (r[0], r[1])):
        s = state.setdefault(owner, {"open": 0, "memory": "", "last": None, "ignored": set()})
        if kind == "suppress":
            s["open"] += 1
        elif kind == "decision":
            out[owner, seq] = "applied" if s["last"] else "refused"
            last, last_path = s["last"] or (None, None)
            s["last"] = None
            if last is None:
                continue
            if choice == "sanitize":
                s["open"] += 1
                s["memory"] = clean.get(last, last)
            elif choice == "ignore" and last_path:
                s["ignored"].add(last_path)
        else:
            s["last"] = None
            if s["open"] > 0:
                s["open"] -= 1
                s["memory"] = text
                outcome = "suppressed"
            elif text == "" or text == s["memory"]:
                outcome = "unchanged"
            else:
                s["memory"] = text
                if len(text.encode()) > LIMIT:
                    outcome = "too_large"
                elif path in s["ignored"]:
                    outcome = "ignored"
                else:
                    outcome = "low" if text in (MAIL, "<API_KEY>", "plain") else "alert"
                    if outcome == "alert":
                        s["last"] = (text, path)
            out[owner, seq] = outcome
    return out


def random_rows(n_owners, n, seed):
    rnd = random.Random(seed)
    rows = []
    for o in range(n_owners):
        steps = []
        for _ in range(n):
            kind = rnd.random()
            if kind < 0.12:
                steps.append(S)
            elif kind < 0.4:
                steps.append(rnd.choice([IGN, SAN, ALLOW]))
            else:
                text = rnd.choice([K1, K2, K1, "", "", MAIL, AWS, "plain", "<API_KEY>", "y" * 300])
                steps.append((text, rnd.choice([None, "", "/f", "/g"])))
        rows += rows_of(f"o{o}", steps)
    return rows


def test_sequences(spark):
    rows, wanted = [], {}
    for i, (steps, alerts) in enumerate(SEQUENCES):
        rows += rows_of(f"s{i:02d}", steps)
        wanted[f"s{i:02d}"] = alerts
    source = frame(spark, rows)
    alerted = monitor(source, max_bytes=LIMIT, width=2).filter("outcome = 'alert'")
    got = {o: [] for o in wanted}
    for r in alerted.join(source, ["owner", "seq"]).orderBy("owner", "seq").collect():
        got[r.owner].append(r.text)
    assert got == wanted


@pytest.mark.parametrize("width", [40, 100_000])
def test_batch_equals_a_plain_loop(spark, width):
    # One owner with most of the rows, numbers that lie far apart.
    rows = [(o, seq * 1_000_003, *r) for o, seq, *r in random_rows(5, 60, seed=width) + random_rows(1, 500, seed=1)[300:]]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    want, df = model(rows), frame(spark, rows)
    got = {(r.owner, r.seq): r.outcome for r in monitor(df, max_bytes=LIMIT, width=width).collect()}
    decided = {(r.owner, r.seq): r.outcome for r in decisions(df, max_bytes=LIMIT, width=width).collect()}
    assert got | decided == want and set(decided.values()) == {"applied", "refused"}


def test_long_memory_over_many_chunks(spark):
    """Paths ignored and suppressions opened far back still count."""
    steps = [(K1, "/f"), IGN] + [S] * 30 + [f"t{i}" for i in range(30)] + [(K2, "/f"), SAN, "", "", (K3, "/g"), SAN, K1, (K2, "/f")]
    rows = rows_of("a", steps) + rows_of("b", [(K1, "/f")])
    got = monitor(frame(spark, rows), max_bytes=LIMIT, width=8).collect()
    want = {k: v for k, v in model(rows).items() if v not in ("applied", "refused")}
    assert {(r.owner, r.seq): r.outcome for r in got} == want
    assert want["b", 0] == "alert" and want["a", 62] == "ignored"


def test_stream_equals_a_plain_loop(spark, tmp_path):
    rows = random_rows(6, 90, seed=9)
    want = model(rows)
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for part in range(3):
        chunk = [r for r in rows if part * 30 <= r[1] < (part + 1) * 30]
        frame(spark, chunk).repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW_SCHEMA).parquet(source)
        write_stream(monitor_stream(stream, max_bytes=LIMIT), out, state, once=True).awaitTermination()
    done = spark.read.parquet(out)
    assert {(r.owner, r.seq): r.outcome for r in done.collect()} == want
    assert stream_alerts(done).filter("message LIKE 'Risk %/100 (%) — %'").count() == sum(
        o == "alert" for o in want.values()
    )
    # What a decision puts in place of the text is found by the number of its tick, as in the batch.
    source = frame(spark, rows)
    clean, batch = (
        {(r.owner, r.decision_seq): r.sanitized for r in sanitized_texts(source, decided=d).collect()}
        for d in (done, decisions(source, max_bytes=LIMIT))
    )
    assert clean and clean == batch and set(clean.values()) <= {"<API_KEY>", "<AWS_KEY>"}


def test_changes_without_scanning(spark):
    rows = rows_of("a", [K1, K1, "", K1, K2, K1])
    got = changed_ticks(frame(spark, rows), width=2).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 4, 5]


def test_bad_rows_go_to_the_error_table(spark):
    rows = [(None, 1, "tick", "x", None, None), ("a", None, "tick", "x", None, None),
            ("a", 1, "other", "x", None, None), ("a", 2, None, "x", None, None), ("a", 3, "tick", "x", None, None)]
    df = frame(spark, rows)
    assert sorted(r.reason for r in bad_rows(df).collect()) == [
        "no owner", "no sequence number", "unknown kind", "unknown kind"]
    assert monitor(df).count() == 1


def test_prefix_scan_equals_a_window(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i * 3, rnd.randint(-3, 3),
             rnd.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, n BIGINT, v BIGINT, x BIGINT")
    got = prefix_scan(df, ["k"], "n", sums={"s": "v"}, lows={"low": "v"}, lasts={"l": "x"}, width=17)
    state = {}
    want = {}
    for k, n, v, x in rows:
        s, low, last = state.get(k, (0, None, None))
        want[n] = (s, low, last)
        s += v
        state[k] = (s, s if low is None else min(low, s), x if x is not None else last)
    assert {r.n: (r.s, r.low, r.l) for r in got.collect()} == want


def test_rules_are_read_again_for_each_batch(spark, tmp_path):
    from textwarden.functions.rules import Rule, builtin_rules

    source = str(tmp_path / "in")
    calls, seen = [], []

    def load(session):
        calls.append(1)
        return (*builtin_rules(), Rule(29, "w", "Word", "foo", risk=30.0)) if len(calls) > 1 else ()

    def write(scored, number):
        seen.append([(r.text, r.score) for r in scored.collect()])

    for _ in range(2):
        spark.createDataFrame([("foo",)], "text STRING").write.mode("append").parquet(source)
        stream = spark.readStream.schema("text STRING").parquet(source)
        scan_stream(stream, load, write, str(tmp_path / "state"), once=True).awaitTermination()
    assert [s for s in seen if s] == [[("foo", 0)], [("foo", 30)]]


def test_alert_rate(spark):
    df = spark.sql("SELECT timestamp_seconds(1704067200 + id * 100) AS ts, if(id % 2 = 0, 'HIGH', 'MEDIUM') AS level FROM range(6)")
    got = {(str(r.window_start), r.level): r.alerts for r in alert_rate(df).collect()}
    assert sum(got.values()) == 6 and len(got) == 4


def test_whole_turns_of_all_roles_are_compared(spark, tmp_path):
    import __spark_entry__ as entry

    turns = [("a", 0, "user", "same"), ("a", 1, "assistant", "same"), ("a", 2, "assistant", "reply"), ("a", 3, "user", None),
             ("a", 4, "assistant", "other reply"), ("b", 0, "assistant", "reply")]
    rows = spark.createDataFrame(turns, "conv_id STRING, turn INT, role STRING, text STRING")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["monitor_changes_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.owner, r.seq) for r in got) == [("a", 0), ("a", 4), ("a", 8), ("b", 0)]


def test_every_row_has_the_rules_of_its_time(spark, tmp_path):
    """In batch, and in a stream whose rules change between two micro-batches."""
    from textwarden.operators.rule_versions import narrow_as_of, rule_versions
    from textwarden.sources.rule_files import RAW_COLUMNS
    from textwarden.streaming.monitor import monitor_narrow, read_narrow, scan_ticks

    types = "string int string int string string string string string double boolean boolean".split()
    schema = ", ".join(f"{c} {t}" for c, t in zip(["since", *RAW_COLUMNS], ["timestamp", *types]))
    at = lambda seq: F.timestamp_seconds(F.lit(1704067200 + seq))
    start = spark.range(1).select(at(0)).first()[0]
    later = spark.range(1).select(at(4)).first()[0]
    last = spark.range(1).select(at(8)).first()[0]
    definition = lambda since, pos, word, risk: (since, None, 0, None, pos, word, word, word, "g", None, risk, False, True)
    rows = [
        definition(start, 0, "apple", 40.0), definition(start, 1, "pear", 40.5),
        definition(later, 0, "pear", 10.0), definition(later, 1, "[bad", 90.0),
        (last, *(None,) * 12),  # the built-in rules alone
    ]
    table = spark.createDataFrame(rows, schema)
    versions = rule_versions(table)
    assert [[r.id for r in v.rules[29:]] for v in versions] == [["apple", "pear"], ["pear"], []]
    with pytest.raises(ValueError):
        rule_versions(spark.range(40).select(at(0).alias("_"), F.timestamp_seconds("id").alias("since"), *(F.lit(None).alias(c) for c in RAW_COLUMNS)))

    steps = ["apple", "pear", "apple pear", "x", "apple", "pear", K1, "pear pear", "apple again", K2]
    source = frame(spark, rows_of("a", steps))
    early = frame(spark, rows_of("b", ["apple"])).withColumn("ts", at(-5))
    timeless = frame(spark, rows_of("c", ["apple"])).withColumn("ts", F.lit(None).cast("timestamp"))
    source = source.union(early).union(timeless)
    want = {("a", i): o for i, o in enumerate(["alert"] * 3 + ["low"] * 3 + ["alert", "low", "low", "alert"])}
    want |= {("b", 0): "low", ("c", 0): "low"}
    got = monitor(source, max_bytes=LIMIT, scan=lambda r: narrow_as_of(r, versions, LIMIT))
    assert {(r.owner, r.seq): r.outcome for r in got.collect()} == want
    assert {r.seq: r.score for r in got.filter("owner = 'a'").collect()}[1] == 40.5

    folder = str(tmp_path)
    for part, known in ((F.col("seq") < 4, "since < timestamp_seconds(1704067204)"), (F.col("seq") >= 4, "true")):
        source.filter(part).write.mode("append").parquet(f"{folder}/in")
        chosen = table.filter(known)
        for _ in range(2):  # the second start finds nothing new to scan
            scan_ticks(
                spark.readStream.schema(ROW_SCHEMA).parquet(f"{folder}/in"), lambda session, t=chosen: rule_versions(t),
                f"{folder}/narrow", f"{folder}/scanned", LIMIT, once=True,
            ).awaitTermination()
        write_stream(
            monitor_narrow(read_narrow(spark, f"{folder}/narrow")), f"{folder}/out", f"{folder}/state", once=True
        ).awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    assert {(r.owner, r.seq): r.outcome for r in done.collect()} == want


@pytest.mark.parametrize("files", [1, 3])
def test_pages_stream_from_a_file_or_a_folder(spark, tmp_path, files):
    import __spark_entry__ as entry

    pages = spark.createDataFrame([(i, f"https://h/{i}", f"page {i} {K1 if i % 2 else ''}") for i in range(9)], "page_id BIGINT, url STRING, html STRING")
    folder = tmp_path / "pages.parquet"
    pages.repartition(files).write.parquet(str(folder))
    pages.write.parquet(f"{tmp_path}/other.parquet")
    if files == 1:
        part = next(folder.glob("part-*.parquet")).read_bytes()
        (tmp_path / "sf").mkdir()
        (tmp_path / "sf" / "pages.parquet").write_bytes(part)
    got = entry.queries()["stream_scan_pages"](spark, str(tmp_path / "sf" if files == 1 else tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, 60 * (i % 2), "HIGH" if i % 2 else "LOW") for i in range(9)]


def test_equal_texts_of_a_batch_are_scanned_as_one_and_none_is_rewritten(spark):
    import pyarrow as pa

    from textwarden.operators.monitor import narrow_ticks
    from textwarden.operators.ticks import pack

    texts = ["a", None, "b", "a", "", None, "a"]
    batch = pa.RecordBatch.from_pydict({"seq": list(range(7)), "text": texts})
    (done,) = pack([batch])
    got = {r["text"]: [x["seq"] for x in r["rows"]] for r in done.to_pylist()}
    assert got == {"a": [0, 3, 6], "b": [2], "": [4], None: [1, 5]} and done.num_rows == 4
    assert pack([batch.slice(1, 1)]).__next__().to_pylist() == [{"text": None, "rows": [{"seq": 1}]}]

    # Equal texts on different paths keep their own scores.
    rows = frame(spark, rows_of("a", [(K1, "/f"), IGN, (K1, "/w/.env"), ("", "/f"), (None, "/f"), S, ("x" * 300, None)]))
    narrow = narrow_ticks(rows, max_bytes=LIMIT)
    assert {r.seq: (r.score, r.is_empty, r.too_large) for r in narrow.filter("kind = 'tick'").collect()} == {
        0: (60, False, False), 2: (50, False, False), 3: (0, True, False), 4: (0, True, False), 6: (0, False, True)}
    assert "regexp_replace" not in narrow._jdf.queryExecution().optimizedPlan().toString()
