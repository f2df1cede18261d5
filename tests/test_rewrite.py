import random

from pyspark.sql import functions as F

from textwarden.functions.rewrite import (
    rewrite_chain, rewrite_once, sanitize, sanitize_corpus, sanitize_range,
)
from textwarden.functions.rules import Rule, builtin_rules
from textwarden.plans.fixtures import SAMPLES

TOKEN = "eyJhIjoxfQ.eyJiIjoyfQ.c2ln-bmF0"
KEY = "sk-" + "Zm4k" * 6
CASES = [
    (f"curl -u {KEY}: http://10.1.2.3/", "curl -u <API_KEY>: http://<IP_ADDRESS>/"),
    ("pwd:\"ab\" then AUTH_TOKEN = 'cd'", "pwd:\"<SECRET>\" then AUTH_TOKEN = '<SECRET>'"),
    (f"{KEY},{KEY}", "<API_KEY>,<API_KEY>"),
    (
        f"auth_token='t' {TOKEN} it@dept.gov 8.8.4.4 AKIA{'7QX2' * 4} {KEY}",
        "auth_token='<SECRET>' <JWT_TOKEN> <EMAIL> <IP_ADDRESS> <AWS_KEY> <API_KEY>",
    ),
    (f'pass: "{KEY}"', 'pass: "<SECRET>"'),
    (f"X-Auth: Bearer {TOKEN}", "X-Auth: Bearer <JWT_TOKEN>"),
    ("postgres://svc:q@pg.office.net:5433/x", "postgres://svc:<EMAIL>:5433/x"),
    ("postgresql://app:pa-55@db:6432/sales", "<POSTGRESQL_CONNECTION>sales"),
    ("pwd = \"it's\"", "pwd = \"<SECRET>'s\""),
    (
        "-----BEGIN EC PRIVATE KEY-----\n" + "q8Z+" * 12 + "\n-----END EC PRIVATE KEY-----",
        "<PRIVATE_KEY_BLOCK>\n<BASE64_SECRET>\n-----END EC PRIVATE KEY-----",
    ),
    ("a quiet afternoon", "a quiet afternoon"),
    ("", ""),
    (None, None),
]


def test_goldens(units):
    rows = sanitize_corpus(units([c[0] for c in CASES])).orderBy("doc_id").collect()
    assert [r.sanitized for r in rows] == [c[1] for c in CASES]
    assert [r.changed for r in rows] == [c[0] != c[1] for c in CASES]


def _texts(n=400, seed=5):
    rnd = random.Random(seed)
    glue = ["", " ", "\n", ":", "é", '"', "@", "=", "/", "-", "<", ">", "sk-", "0x", "postgres://"]
    return [
        "".join(rnd.choice(SAMPLES) + rnd.choice(glue) for _ in range(rnd.randint(1, 5)))
        for _ in range(n)
    ]


def test_skipped_steps_change_nothing(units):
    """The guarded chain equals every rewrite in turn, on texts where rewrites meet."""
    plain = "text"
    for rule in builtin_rules():
        plain = rewrite_once(plain, rule)
    df = units(_texts()).select(
        F.expr(plain).alias("plain"), F.expr(rewrite_chain()).alias("guarded")
    )
    assert df.filter(~F.col("plain").eqNullSafe(F.col("guarded"))).count() == 0


def test_text_without_findings_is_left_alone(units):
    from textwarden.functions.detect import any_hit

    df = units(_texts(200, 6) + ["clean", "also clean"]).select(
        "text", F.expr(any_hit()).alias("hit"), F.expr(sanitize()).alias("clean")
    )
    assert df.filter("NOT hit AND text <> clean").count() == 0


def test_custom_rules_run_last_and_keep_their_tokens(units):
    rules = (*builtin_rules(), Rule(29, "w", "Word", r"(foo)-(bar)", placeholder="$2 cost$ \\ $&"))
    out = sanitize_corpus(units(["foo-bar 1.2.3.4"]), rules).first().sanitized
    assert out == "bar cost$ \\ foo-bar <IP_ADDRESS>"


def test_range_sees_only_its_slice(units):
    df = sanitize_range(units(["ab 1.2.3.4 1.2.3.45"]), F.lit(3), F.lit(18))
    assert df.first().sanitized == "ab <IP_ADDRESS> <IP_ADDRESS>5"


def test_excluded_units_pass_through(units):
    rows = sanitize_corpus(units(["1.2.3.4", "1.2.3.4"]), excluded=F.col("doc_id") == 1)
    assert [(r.sanitized, r.changed) for r in rows.orderBy("doc_id").collect()] == [
        ("<IP_ADDRESS>", True), ("1.2.3.4", False)
    ]
