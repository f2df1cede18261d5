from pyspark.sql import functions as F

from textwarden.functions.risk import path_context, score_units
from textwarden.functions.rules import Rule, builtin_rules

TOKEN = "eyJhIjoxfQ.eyJiIjoyfQ.c2ln-bmF0"
KEY = "sk-" + "Zm4k" * 6
PW = 'pwd: "harbour"'
TESTS = "describe('a'); it('b');\nexpect(1)\n jest.fn()"
CASES = [
    ("a quiet afternoon", None, 0, "LOW"),
    (TOKEN, None, 25, "LOW"),
    (PW, None, 35, "MEDIUM"),
    (PW, "", 35, "MEDIUM"),
    (PW, "/srv/app/.env", 25, "LOW"),
    (PW, "D:\\app\\.env", 25, "LOW"),
    ("it@dept.gov", "/srv/app/README.md", 20, "LOW"),
    (PW, "/srv/app/test/secrets.txt", 20, "LOW"),
    (PW, "D:\\app\\test\\secrets.txt", 20, "LOW"),
    (f"{TOKEN} 8.8.4.4 it@dept.gov {PW}", "/srv/app/test/.env", 95, "HIGH"),
    (
        f"{KEY} AKIA{'7QX2' * 4} {TOKEN} 8.8.4.4 it@dept.gov {PW}",
        "/srv/app/README.md", 100, "HIGH",
    ),
    (f"KEY={KEY}", "/w/.env", 50, "MEDIUM"),
    (PW, "/w/.env.example", 20, "LOW"),
    (PW, "/w/src/__tests__/a.ts", 15, "LOW"),
    (PW, "/w/a.spec.ts", 15, "LOW"),
    (PW, "/w/testing/a.spec.ts", 35, "MEDIUM"),
    (PW, "/w/docs/a.txt", 25, "LOW"),
    (PW, "/w/a.md", 25, "LOW"),
    (PW, "/w/main.tf", 30, "MEDIUM"),
    (PW, "/w/k8s/a.yaml", 30, "MEDIUM"),
    (PW, "test/a.txt", 35, "MEDIUM"),
    (PW + "\n" + TESTS, "test/a.txt", 15, "LOW"),
    (PW + "\n" + TESTS, "/w/a.txt", 35, "MEDIUM"),
    (PW, "prod.env", 25, "LOW"),
    (PW, "/w/templates/README.md", 30, "MEDIUM"),
    (PW, "/w/readme.md", 25, "LOW"),
    (PW, "/W/TEST/a.txt", 35, "MEDIUM"),
    ("it@dept.gov", "/w/.env.template", 0, "LOW"),
    (f"{TOKEN} 8.8.4.4", None, 60, "HIGH"),
    (f"{TOKEN} 8.8.4.4 it@dept.gov", None, 70, "HIGH"),
]


def test_scores_and_levels(units):
    rows = score_units(units([c[:2] for c in CASES]), path="path").orderBy("doc_id").collect()
    assert [(r.score, r.level) for r in rows] == [c[2:] for c in CASES]


def test_contexts(units):
    paths = ["/w/config.template.js", "/a/example.config.ts", "/w/e2e/a.ts", "test.ts", "/w/a.TF", "/w/x"]
    df = units([("", p) for p in paths]).select("doc_id", F.expr(path_context()).alias("c"))
    got = [r.c for r in df.orderBy("doc_id").collect()]
    assert got == ["template", "template", "test", "test", "infrastructure", None]


def test_critical_custom_rule_lifts_the_score(units):
    rules = (*builtin_rules(), Rule(29, "c", "C", "token42", risk=30.0, critical=True))
    row = score_units(units(["token42"]), rules).first()
    assert (row.score, row.level) == (60, "HIGH")


def test_fractional_risks_stay_fractional(units):
    rules = (*builtin_rules(), Rule(29, "c", "C", "token42", risk=30.5))
    row = score_units(units(["token42"]), rules).first()
    assert row.score == 30.5 and row.level == "MEDIUM"


def test_score_stays_in_range(units):
    from textwarden.plans.fixtures import PATHS, SAMPLES

    pairs = [(" ".join(SAMPLES[: i % 32]), p) for i in range(64) for p in PATHS[:6]]
    bad = score_units(units(pairs), path="path").filter("score < 0 OR score > 100")
    assert bad.count() == 0
