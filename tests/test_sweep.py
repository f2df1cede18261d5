import random

from pyspark.sql import functions as F

from textwarden.functions.rewrite import replace_span
from textwarden.functions.rules import Rule
from textwarden.operators.spans import detect_spans, placeholder_of
from textwarden.operators.sweep import sanitize_spans, sweep_text

RULES = tuple(
    Rule(29 + i, name, name, pattern, "g", f"<{name}>")
    for i, (name, pattern) in enumerate([("AB", "ab+"), ("BC", "b+c"), ("CD", "c[de]*"), ("É", "é.")])
)
NAMES = [r.id for r in RULES] + ["nobody"]
SPANS = "array<struct<start:int,`end`:int,pattern_id:string>>"


def _plain(text, spans):
    """Character by character: covered ones go, the first span of a stretch leaves its name."""
    if text is None:
        return None
    good = [
        (s, min(e, len(text)), p) for s, e, p in spans or []
        if s is not None and e is not None and p in NAMES[:-1] and 0 <= s < min(e, len(text))
    ]
    out, i, order = "", 0, sorted(range(len(good)), key=lambda k: (good[k][0], k))
    while i < len(text):
        here = [k for k in order if good[k][0] == i]
        if not here:
            out, i = out + text[i], i + 1
            continue
        out += f"<{good[here[0]][2]}>"
        end = good[here[0]][1]
        while any(good[k][0] < end < good[k][1] for k in order if good[k][0] >= i):
            end = max(good[k][1] for k in order if i <= good[k][0] < end)
        i = end
    return out


def test_planted_overlaps_agree_with_a_plain_loop(spark):
    rnd = random.Random(7)
    rows = [(0, None, [(0, 1, "AB")]), (1, "", [(0, 0, "AB")]), (2, "abc", None), (3, "abc", [])]
    for i in range(4, 500):
        text = "".join(rnd.choice("abcdé\U0001F600 ") for _ in range(rnd.randint(0, 30)))
        spans = [
            (rnd.choice([None, -1, *range(31)]), rnd.choice([None, *range(35)]), rnd.choice([*NAMES, None]))
            for _ in range(rnd.randint(0, 8))
        ]
        rows.append((i, text, spans + spans[:1]))
    df = spark.createDataFrame(rows, f"id INT, text STRING, spans {SPANS}").repartition(5)
    got = {r.id: r.out for r in df.select("id", sweep_text(F.col("text"), F.col("spans"), RULES).alias("out")).collect()}
    for i, text, spans in rows:
        assert got[i] == _plain(text, spans), (text, spans)


def test_units_stay_one_row_and_agree_with_span_by_span(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdeé \n") for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").selectExpr("*", "'old' AS sanitized", "1 AS extra")
    done = sanitize_spans(df, RULES)
    assert done.columns == ["id", "text", "extra", "sanitized"]
    got = {r.id: r.sanitized for r in done.collect()}
    spans: dict = {}
    for r in detect_spans(df, RULES).select("id", "start", "end", "pattern_id").collect():
        spans.setdefault(r.id, []).append((r.start, r.end, r.pattern_id))
    assert got == {i: _plain(texts[i], s) for i, s in spans.items()} and len(got) > 200


def test_apart_spans_give_what_single_rewrites_give(spark):
    df = spark.createDataFrame([("ab é1 cd",)], "text STRING")
    step = df
    for start, end, name in [(6, 8, "CD"), (3, 5, "É"), (0, 2, "AB")]:
        step = step.select(replace_span(F.col("text"), F.lit(start), F.lit(end), placeholder_of(F.lit(name), RULES)).alias("text"))
    assert sanitize_spans(df, RULES).first().sanitized == step.first().text == "<AB> <É> <CD>"


def test_many_spans_in_one_text(spark):
    df = spark.createDataFrame([("ab " * 200_000,)], "text STRING")
    rules = RULES[:1]
    spans = F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.struct(
        (i * 3).alias("start"), (i * 3 + 2).alias("end"), F.lit("AB").alias("pattern_id")))
    assert df.select(sweep_text(F.col("text"), spans, rules).alias("o")).first().o == "<AB> " * 200_000


def test_no_units(spark):
    assert sanitize_spans(spark.createDataFrame([], "id INT, text STRING"), RULES).collect() == []
