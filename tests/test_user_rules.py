import json

from pyspark.sql import functions as F

from textwarden.functions.risk import score_matched, score_units
from textwarden.functions.rules import BUILTIN_COUNT
from textwarden.operators.custom_rules import (
    collect_rules, compile_rules, find_rules, match_repo_rules, rule_errors, sanitize_matched, warn_once,
)
from textwarden.sources.rule_files import load_rule_files, merge_rule_sources, parse_rule_files


def rule(i, **more):
    return {"id": f"r{i}", "label": f"Rule {i}", "regex": f"word{i}\\b", **more}


def raw(spark, files):
    rows = [(repo, repo, c if isinstance(c, str) else json.dumps(c)) for repo, c in files]
    return parse_rule_files(spark.createDataFrame(rows, "repo_id STRING, folder STRING, content STRING"))


def test_unusable_files_have_no_rules(spark):
    files = [("a", "not json"), ("b", {}), ("c", {"patterns": "text"}), ("d", "[1]"), ("e", "null"),
             ("f", {"patterns": {"0": rule(1)}}), ("g", "")]
    assert raw(spark, files).count() == 0


def test_only_well_formed_entries_are_kept(spark):
    entries = [rule(1), {"id": "x"}, {"label": "x", "regex": "x"}, {**rule(2), "id": 7}, {**rule(3), "id": ""},
               {**rule(4), "regex": None}, None, 3, "text", [rule(5)], {**rule(6), "label": True}, rule(7)]
    assert [r.id for r in raw(spark, [("a", {"patterns": entries})]).orderBy("pos").collect()] == ["r1", "r7"]


def test_defaults_clamps_and_drops(spark):
    entries = [
        rule(0), rule(1, riskScore=-50), rule(2, riskScore=200), rule(3, riskScore=12.5, critical=True),
        rule(4, enabled=False), rule(5, regex="[invalid(("), rule(6, flags="y"), rule(7, flags="i"),
        rule(8, placeholder="cost$", enabled="false"), rule(9, riskScore="40"), rule(10, flags="gg"),
    ]
    entries[5]["regex"] = "[invalid(("
    rows = {r.id: r for r in compile_rules(raw(spark, [("a", {"patterns": entries})])).collect()}
    assert set(rows) == {"r0", "r1", "r2", "r3", "r7", "r8", "r9"}
    assert (rows["r0"].flags, rows["r0"].placeholder, rows["r0"].risk, rows["r0"].critical) == (
        "g", "<REDACTED>", 0.0, False)
    assert [rows[f"r{i}"].risk for i in (1, 2, 3, 9)] == [0.0, 100.0, 12.5, 40.0]
    assert rows["r3"].critical and rows["r8"].replacement == "cost\\$"


def test_errors_name_the_rule_once(spark):
    bad = {"patterns": [rule(1, regex="[[invalid"), rule(2)]}
    bad["patterns"][0]["regex"] = "[[invalid"
    errors = rule_errors(raw(spark, [("a", bad), ("b", bad)]))
    assert errors.count() == 2
    assert [r.message for r in warn_once(errors).collect()] == [
        'ignoring custom pattern "r1" — invalid regex: [[invalid'
    ]


def test_the_limit_counts_definitions(spark):
    entries = [rule(i, enabled=i % 2 == 0) for i in range(60)]
    defs = raw(spark, [("a", {"patterns": entries})])
    assert compile_rules(defs).count() == 25
    assert compile_rules(defs, max_custom=None).count() == 30
    plain = raw(spark, [("a", {"patterns": [rule(i) for i in range(60)]})])
    assert len(collect_rules(compile_rules(plain, key=None))) == BUILTIN_COUNT + 50
    assert compile_rules(plain).agg(F.min("ord"), F.max("ord")).first() == (BUILTIN_COUNT, BUILTIN_COUNT + 49)


def test_repository_rules_come_before_settings_and_ids_may_repeat(spark):
    repo = raw(spark, [("b", {"patterns": [rule(1)]}), ("a", {"patterns": [rule(2)]})])
    settings = raw(spark, [("0", {"patterns": [rule(1, riskScore=9)]})])
    rules = collect_rules(compile_rules(merge_rule_sources(repo, settings), key=None))[BUILTIN_COUNT:]
    assert [(r.id, r.risk) for r in rules] == [("r2", 0.0), ("r1", 0.0), ("r1", 9.0)]
    first = find_rules(compile_rules(merge_rule_sources(repo, settings), key=None)).collect()
    assert {(r.id, r.risk) for r in first} == {("r2", 0.0), ("r1", 0.0)}


def test_rules_are_read_from_folders(spark, tmp_path):
    for repo, content in (("one", {"patterns": [rule(1)]}), ("two", {"patterns": [rule(2), rule(3)]})):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "textwarden.json").write_text(json.dumps(content, indent=2))
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "other.json").write_text("{}")
    files = load_rule_files(spark, str(tmp_path))
    assert files.count() == 2
    rows = parse_rule_files(files).collect()
    assert sorted((r.repo_id.rsplit("/", 1)[1], r.id) for r in rows) == [("one", "r1"), ("two", "r2"), ("two", "r3")]


def test_each_unit_meets_its_own_repository(spark):
    rules = compile_rules(raw(spark, [
        ("a", {"patterns": [rule(1, riskScore=40, placeholder="<A>"), rule(9, regex="z")]}),
        ("b", {"patterns": [rule(1, riskScore=10, critical=True, flags="i", placeholder="<$&>")]}),
    ]))
    units = spark.createDataFrame(
        [(1, "a", "word1 1.2.3.4"), (2, "b", "WORD1"), (3, "c", "word1"), (4, "a", "none"), (5, None, "word1 a@b.co")],
        "doc_id INT, repo_id STRING, text STRING",
    )
    matched = match_repo_rules(units, rules)
    scored = {r.doc_id: (r.findings, r.score) for r in score_matched(matched, whole=False).collect()}
    assert scored == {
        1: (["IP address", "Rule 1"], 75.0), 2: (["Rule 1"], 60.0), 3: ([], 0.0), 4: ([], 0.0), 5: (["Email"], 10.0)
    }
    salted = score_matched(match_repo_rules(units, rules, salts=3), whole=False).collect()
    assert {r.doc_id: (r.findings, r.score) for r in salted} == scored
    shuffled = match_repo_rules(units, rules, max_broadcast=0)
    assert "BroadcastHashJoin" in matched._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.findings, r.score) for r in score_matched(shuffled, whole=False).collect()} == scored
    clean = {r.doc_id: r.sanitized for r in sanitize_matched(matched).collect()}
    assert clean == {1: "<A> <IP_ADDRESS>", 2: "<WORD1>", 3: "word1", 4: "none", 5: "word1 <EMAIL>"}


def test_joined_and_unrolled_rules_agree(spark):
    defs = raw(spark, [("a", {"patterns": [rule(i, riskScore=i * 7, flags="i" if i % 2 else "g") for i in range(8)]})])
    texts = [f"Word{i} word{(i * 3) % 8} 1.2.3.{i}" for i in range(40)]
    units = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id INT, repo_id STRING, text STRING")
    literal = score_units(units, collect_rules(compile_rules(defs, key=None)))
    joined = score_matched(match_repo_rules(units, compile_rules(defs)))
    assert literal.select("doc_id", "score", "findings").exceptAll(joined.select("doc_id", "score", "findings")).count() == 0


def _definitions(spark, regexes):
    rows = [("a", 0, "a", i, f"r{i}", f"L{i}", regex, flags, None, 7.0, False, True) for i, (regex, flags) in enumerate(regexes)]
    schema = (
        "repo_id string, source_rank int, folder string, pos int, id string, label string, regex string, flags string, "
        "placeholder string, risk_score double, critical boolean, enabled boolean"
    )
    return spark.createDataFrame(rows, schema)


def test_a_large_shared_set_finds_what_an_unrolled_one_does(spark, units):
    import random

    from textwarden.functions.detect import with_matched
    from textwarden.operators.custom_rules import collect_rules, compile_rules
    from textwarden.operators.shared_rules import match_shared_rules

    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcde", k=n))
    regexes = [(word(r.randint(4, 6)), r.choice(["g", "i", "g"])) for _ in range(150)]
    regexes += [("STRAßE", "i"), ("ασΣ", "g"), ("ab", "g"), ("(?:abcd|dcba)", "g"), (r"\bcab\w+", "g"), ("aaaa+b", "i")]
    regexes += [("caba" * 3, "g"), ("[bad((", "g"), ("abca|", "g"), (r"a\.b\.c\.d", "g")]
    texts = [" ".join(word(r.randint(1, 30)).upper() if r.random() < 0.3 else word(r.randint(1, 30)) for _ in range(40)) for _ in range(60)]
    texts += ["straße Straße", "xασΣ", "xασΣα", "cabacabacabacaba", "a.b.c.d", "AAAAB", "", None, "abc"]
    rules = compile_rules(_definitions(spark, regexes), None, key=None)
    df = units(texts)
    labels = lambda d: {x.doc_id: [m.label for m in x.matched] for x in d.collect()}
    want = labels(with_matched(df, collect_rules(rules)))
    got = labels(match_shared_rules(df, rules))
    assert got == want and sum(map(len, want.values())) > 500


def test_thousands_of_rules(spark, units):
    from textwarden.operators.custom_rules import compile_rules
    from textwarden.operators.shared_rules import match_shared_rules

    words = [f"key{i:04d}x" for i in range(3000)]
    rules = compile_rules(_definitions(spark, [(w, "g") for w in words]), None, key=None)
    # One rule is met by a third of all texts.
    texts = [f"{words[i * 7 % 3000]} and {words[(i * 31 + 5) % 3000]} {words[9] if i % 3 == 0 else ''}" for i in range(300)]
    got = {x.doc_id: {m.label for m in x.matched} for x in match_shared_rules(units(texts), rules).collect()}
    assert got == {i: {f"L{words.index(w)}" for w in t.split() if w != "and"} for i, t in enumerate(texts)}
    plan = match_shared_rules(units(texts), rules)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_are_moved_once_however_many_rules_they_meet(spark, units):
    from textwarden.operators.custom_rules import compile_rules
    from textwarden.operators.shared_rules import match_shared_rules

    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rules = compile_rules(_definitions(spark, [(w, "i" if i % 3 else "g") for i, w in enumerate(words)]), None, key=None)
    texts = [" ".join(words).upper(), " ".join(words), "wordaa", "", None]
    done = match_shared_rules(units(texts), rules)
    got = {x.doc_id: len(x.matched) for x in done.collect()}
    assert got == {0: 133, 1: 200, 2: 1, 3: 0, 4: 0}
    # Only the join of texts with their rules exchanges rows that hold a text.
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "RepartitionByExpression [doc_id" in plan
    assert len([x for x in plan.splitlines() if "Join " in x and "ord#" not in x and "piece#" not in x]) == 1
