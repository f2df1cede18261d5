import re

from pyspark.sql import functions as F

from textwarden.functions.rules import Rule, builtin_rules
from textwarden.operators.spans import (
    detect_spans, diagnostics_rows, sanitize_first_span, sanitize_span, span_positions, utf16_offset,
    with_spans,
)
from textwarden.plans.fixtures import SAMPLES


def test_spans_cut_out_what_the_rule_matches(units):
    texts = [a + g + b for a in SAMPLES for b in SAMPLES[::4] for g in (" ", "\U0001F600")]
    rows = detect_spans(units(texts), keep=("doc_id", "text")).withColumn(
        "cut", F.expr("substring(text, start + 1, `end` - start)")
    )
    assert rows.filter("start < 0 OR `end` <= start OR `end` > length(text)").count() == 0
    regex = {r.id: r.detector() for r in builtin_rules()}
    wrong = [
        r for r in rows.select("pattern_id", "cut").distinct().collect()
        # Without its surroundings a cut may lose a boundary but never the rule's body.
        if not re.search(regex[r.pattern_id].replace(r"\x{", r"\x").replace(r"\z", r"\Z"), r.cut)
    ]
    assert not wrong


def test_order_is_by_start_then_rule(units):
    spans = with_spans(units(["Bearer ya29.abc a@b.co 0x" + "a1" * 32])).first().spans
    got = [(s.start, s.pattern_id) for s in spans]
    assert got == sorted(got, key=lambda x: x[0])
    assert [p for s, p in got if s == 23] == ["high_entropy_base64", "ethereum_private_key"]


def test_offsets_are_code_points_and_can_be_utf16(units):
    df = units(["\U0001F600\U0001F600 1.2.3.4"])
    row = detect_spans(df, keep=("text",)).select(
        "start", "end", utf16_offset(F.col("text"), F.col("start")).alias("u")
    ).first()
    assert (row.start, row.end, row.u) == (3, 10, 5)


def test_an_empty_hit_ends_its_rule(units):
    rules = (Rule(29, "x", "X", "x*"), Rule(30, "y", "Y", "y+"))
    rows = detect_spans(units(["xxaxy", "axx", "yy"]), rules).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.pattern_id, r.start, r.end) for r in rows] == [
        (0, "x", 0, 2), (0, "y", 4, 5), (2, "y", 0, 2)
    ]


def _position(text, offset):
    """Line and character; a \\r\\n is one line end, and its middle is still on the line."""
    line, at = 0, 0
    for m in re.finditer(r"\r\n|\n|\r", text):
        if m.end() <= offset:
            line, at = line + 1, m.end()
    return line, offset - at


def test_positions_agree_with_counting(units, spark):
    rule = (Rule(29, "k", "K", r"K[\r\n]*|[\r\n]+Q"),)
    pieces = ["K", "\r", "\n", "a", "Q", "\r\n", "é", "\U0001F600"]
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    rows = span_positions(units(texts), rule).collect()
    assert rows
    for r in rows:
        text = texts[r.doc_id]
        assert (r.line, r.character) == _position(text, r.start), text
        assert (r.end_line, r.end_character) == _position(text, r.end), text


def test_one_span_is_replaced_and_unknown_rules_change_nothing(units, spark):
    df = spark.createDataFrame(
        [("a 1.2.3.4 b", 2, 9, "ip_address"), ("a 1.2.3.4 b", 2, 9, "nobody")],
        "text STRING, start INT, `end` INT, pattern_id STRING",
    )
    assert [r.sanitized for r in sanitize_span(df).collect()] == ["a <IP_ADDRESS> b", "a 1.2.3.4 b"]
    first = sanitize_first_span(units(["1.2.3.4 5.6.7.8", "none"])).collect()
    assert [(r.doc_id, r.sanitized) for r in first] == [(0, "<IP_ADDRESS> 5.6.7.8")]


def test_the_first_rule_with_an_id_gives_the_placeholder(spark):
    rules = (*builtin_rules(), Rule(29, "ip_address", "Other", "x", placeholder="<OTHER>"))
    df = spark.createDataFrame([("x", 0, 1, "ip_address")], "text STRING, start INT, `end` INT, pattern_id STRING")
    assert sanitize_span(df, rules).first().sanitized == "<IP_ADDRESS>"


def test_diagnostics_skip_large_and_excluded_units(units):
    df = units([("1.2.3.4", "/a/x.ts"), ("1.2.3.4" + " " * 100, "/a/y.ts"), ("1.2.3.4", "/skip/z.ts")])
    rows = diagnostics_rows(df, globs=["/skip/**"], max_bytes=50).collect()
    assert [(r.path, r.message, r.severity, r.code) for r in rows] == [
        ("/a/x.ts", "Sensitive data detected: IP address", "Warning", "ip_address")
    ]


def test_many_hits_in_one_text(units):
    """More hits than a block holds, in one text; also fast enough to be linear."""
    lines = [f"10.0.{i // 250}.{i % 250}" + ("\r\n" if i % 3 else " ") for i in range(20_000)]
    text = "".join(lines)
    rows = span_positions(units([text])).filter("pattern_id = 'ip_address'").orderBy("start").collect()
    found = [(m.start(), m.end()) for m in re.finditer(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", text)]
    assert [(r.start, r.end) for r in rows] == found
    for r in rows[::997]:
        assert (r.line, r.character) == _position(text, r.start)
        assert (r.end_line, r.end_character) == _position(text, r.end)
