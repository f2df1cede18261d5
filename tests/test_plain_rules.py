import random
import re

import numpy as np
import pytest

from textwarden.functions.detect import with_matched
from textwarden.functions.dialect import translate
from textwarden.operators import plain_rules
from textwarden.operators.custom_rules import collect_rules, compile_rules
from textwarden.operators.shared_rules import SENT_BYTES, match_shared_rules
from textwarden.plans.user_rules import QUERIES

# Regexes that are plain, nearly plain, and not plain; flags.
REGEXES = [
    (r"\bto\b", "g"), (r"\bto\b", "i"), (r"\bto\b", "gm"), ("to", "g"), (r"\bt", "g"), ("t", "i"), (r"o\b", "g"), (r"\bñ", "g"),
    (r"ñ\b", "g"), (r"\bto\s+the\b", "g"), (r"\bto\s+the\b", "i"), (r"to\sthe", "g"), (r"(to)(?:\s)+(the)", "g"),
    (r"to\s+\d+the", "g"), (r"to\d+\b", "g"), (r"to\w+", "g"), (r"to\w\b", "g"), (r"to\s+\b", "g"), (r"to\w+the", "g"),
    (r"to\s*the", "g"), (r"to[ ]the", "g"), (r"\.\bto", "g"), (r"\b\.to", "g"), (r"to\s+é", "g"), ("to é", "i"), ("STRAßE", "i"),
    (r"the\s+to\s+the", "i"), (r"to\n", "g"), (r"^to", "m"), (r"to$", "g"), (r"(?=to)th", "g"), (r"to|the", "g"),
    (r"a{2}to", "g"), (r"to\s+?the", "g"), (r"K\b", "i"), (r"(to)\1", "g"), (r"\S+", "g"), ("\\uFFFDto", "g"), (r"\x00to", "g"),
    ("to" * 40, "i"), ("\U0001F600to", "gu"), (r"to\s+\s", "g"), (r"to\B", "g"),
]
SIGNS = [
    "to", "TO", "the", "The", "t", "o", " ", "  ", "\t", "\n", "\u00a0", "\u2003", "\u3000", "\ufeff", "\u2028", "\u0085",
    "ñ", "é", "É", "ß", "\u1e9e", "\u017f", "\u212a", "Ω", "_", "7", ".", "K", "k", "\U0001F600", "\x00", "\ufffd", "aa",
    " " * 40, "x" * 30, "9" * 20,
]


def _texts(n):
    r = random.Random(5)
    return ["".join(r.choices(SIGNS, k=r.randint(0, 14))) for _ in range(n)] + [None, "", "to", "to" * 50, "TO" * 40 + " the", "to" + " " * 500 + "the"]


def _rules(spark, regexes):
    rows = [("a", 0, "a", i, f"r{i}", f"L{i}", regex, flags, None, 7.0, False, True) for i, (regex, flags) in enumerate(regexes)]
    schema = (
        "repo_id string, source_rank int, folder string, pos int, id string, label string, regex string, flags string, "
        "placeholder string, risk_score double, critical boolean, enabled boolean"
    )
    return compile_rules(spark.createDataFrame(rows, schema), None, key=None)


def _matched(df):
    return {x.doc_id: [tuple(m) for m in x.matched] for x in df.collect()}


def test_a_set_that_is_sent_finds_what_an_unrolled_one_does(spark, units):
    rules = _rules(spark, REGEXES + REGEXES[:5])
    df = units(_texts(1500))
    want = _matched(with_matched(df, collect_rules(rules)))
    assert _matched(match_shared_rules(df, rules, max_sent=SENT_BYTES)) == want
    met = {m[2] for found in want.values() for m in found}
    assert len(met) > 40 and sum(map(len, want.values())) > 5000


def test_broken_bytes_are_read_as_the_regex_reads_them(spark):
    texts = ["FF746F", "746FFF", "C3746F20746865", "746FC2746865", "746FE28074", "746F20C2", "EFBFBD746F", "746F80FF207468"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, hex STRING").selectExpr("doc_id", "cast(unhex(hex) as string) AS text")
    rules = _rules(spark, REGEXES)
    want = _matched(with_matched(df, collect_rules(rules)))
    assert _matched(match_shared_rules(df, rules, max_sent=SENT_BYTES)) == want and sum(map(len, want.values())) > 20


def test_no_text_is_moved_for_the_rules_of_the_query(spark, tmp_path):
    benchmark = [(0, "Se que lo"), (1, "On the way"), (2, "to to do"), (3, "no file"), (4, "Über The Hill")]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(i, t, "s", "en") for i, t in enumerate(["ñSe  que", "on\tthe", "To to", "Hill", None, "to to The hill"])]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["custom_rules_uncapped"].run(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # A table of few files is dealt to all cores as it is read; nothing else moves a text.
    moves = [line for line in plan.splitlines() if "Exchange" in line or "Join " in line or "Sort " in line]
    assert all("REPARTITION_BY_NUM" in line for line in moves) and len(moves) <= 1
    found = {r.doc_id: r.findings or "" for r in rows.collect()}
    own = [[f for f in found[i].split(", ") if f.startswith(("Words of", "First of"))] for i in range(6)]
    assert own == [["Words of 0", "First of 0"], [], ["First of 2"], [], [], ["Words of 2", "First of 2"]]


def test_plain_rules_are_never_tried_as_a_regex():
    words = [r"\bto\s+the\b", r"\bthe\b", "the"]
    index = plain_rules.plain_index([plain_rules.probe(translate(w, "i")) for w in words])
    (ends, sure), (tried_ends, tried) = plain_rules.plain_hits(index, [b"To  THE", b"other", b"to\xc2\xa0the", None])
    assert ends.tolist() == [0, 3, 4, 6, 6] and sure.tolist() == [0, 1, 2, 2, 1, 2]
    # White space beyond ASCII is left to the regex.
    assert tried_ends.tolist() == [0, 0, 0, 1, 1] and tried.tolist() == [0]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_and_places_cut_no_hit(monkeypatch, block):
    texts = [t and t.encode() for t in _texts(150)]
    known = [x for x in (plain_rules.probe(translate(*r)) for r in REGEXES if r[0] != r"\S+") if x]
    index = plain_rules.plain_index(known)
    whole = plain_rules.plain_hits(index, texts)
    monkeypatch.setattr(plain_rules, "BLOCK", block)
    monkeypatch.setattr(plain_rules, "PAIRS", 3)
    for a, b in zip(whole, plain_rules.plain_hits(index, texts)):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
    cuts = list(plain_rules.portions([len(t or b"") for t in texts]))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts) and len(cuts) > 20
    parts = [plain_rules.plain_hits(index, texts[a:b]) for a, b in cuts]
    for which in (0, 1):
        assert np.array_equal(whole[which][1], np.concatenate([p[which][1] for p in parts]))


def test_thousands_of_plain_rules():
    r = random.Random(3)
    words = sorted({"".join(r.choices("abcdef", k=r.randint(1, 7))) for _ in range(9000)})
    index = plain_rules.plain_index([plain_rules.probe(translate(rf"\b{w}\b")) for w in words])
    texts = [" ".join("".join(r.choices("abcdef", k=r.randint(1, 7))) for _ in range(50)) for _ in range(200)]
    (ends, sure), (_, tried) = plain_rules.plain_hits(index, [t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert [words[p] for p in sure[ends[i] : ends[i + 1]]] == sorted(set(re.findall(r"\w+", text)) & set(words))
    assert not len(tried)


def test_rules_that_begin_alike_are_told_apart_before_they_are_followed(monkeypatch):
    words = [f"https://www.host.example/path/{i:05d}/" for i in range(20000)]
    index = plain_rules.plain_index([plain_rules.probe(translate(re.escape(w), "i" if i % 2 else "g")) for i, w in enumerate(words)])
    followed = []
    inner = plain_rules._follow
    monkeypatch.setattr(plain_rules, "_follow", lambda *a: followed.append(len(a[-1])) or inner(*a))
    texts = [" ".join(words[(i * 100 + j * 7) % 20000] for j in range(100)).encode() for i in range(50)]
    (ends, sure), (_, tried) = plain_rules.plain_hits(index, texts)
    assert [set(sure[a:b]) for a, b in zip(ends, ends[1:])] == [{(i * 100 + j * 7) % 20000 for j in range(100)} for i in range(50)]
    assert sum(followed) == 5000 and not len(tried)


def test_a_long_run_is_followed_once():
    index = plain_rules.plain_index([plain_rules.probe(translate(r"a\w+ "))])
    (ends, sure), (_, tried) = plain_rules.plain_hits(index, [b"a" * 300000, b"a" * 300000 + b" "])
    assert ends.tolist() == [0, 0, 1] and sure.tolist() == [0] and not len(tried)


def test_no_rules_at_all(spark, units):
    rules = _rules(spark, [("[bad((", "g")])
    found = _matched(match_shared_rules(units(["to 1.2.3.4", None]), rules, max_sent=SENT_BYTES))
    assert [m[1] for m in found[0]] == ["ip_address"] and found[1] == []
