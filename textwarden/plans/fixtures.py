"""Sample strings and paths laid over the given tables, for Spark and for SQL.

The tables hold few secrets and no paths.  Every unit gets one sample appended and
one path assigned by its id, so that each rule and each path context is met, over
the whole table and on both sides of the check.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.sqltext import lit
from textwarden.sources.corpus import scan_corpus

_UPPER, _LOWER, _DIGITS, _HEX = string.ascii_uppercase, string.ascii_lowercase, string.digits, string.digits + "abcdef"
_MIXED = _UPPER + _LOWER + _DIGITS


def made(alphabet: str, n: int) -> str:
    """A made-up value: ``n`` signs drawn from an alphabet, the same every time."""
    return "".join(random.Random(f"{alphabet} {n}").choices(alphabet, k=n))


_TOKEN = ".".join(["eyJ" + made(_MIXED, 9), made(_MIXED, 11), made(_MIXED + "-_", 7) + "k"])

# One text per rule, in rule order, made from what its regex asks for; then near misses, and
# a text with several findings.
SAMPLES = (
    f"export MODEL_KEY=sk-ant-{made(_MIXED, 26)}",
    f"old sk-{made(_MIXED, 20)}, new sk-{made(_LOWER, 31)}",
    f"git clone https://ghs_{made(_MIXED, 36)}:x-oauth@host/r",
    f"AKIA{made(_UPPER + _DIGITS, 16)}",
    f"Authorization: Bearer {_TOKEN}",
    f"-----BEGIN EC PRIVATE KEY-----\n{made(_MIXED + '+/', 64)}\n-----END EC PRIVATE KEY-----",
    "10.20.30.40\r\n172.16.254.3",
    "first.last+tag@mail.host-9.org, \U0001F600 it@dept.gov",
    "Pwd: 'it\"s' api_key = \"k\"",
    f"DefaultEndpointsProtocol=https;AccountName=lake7;AccountKey={made(_MIXED, 24)}==;EndpointSuffix=core.windows.net",
    '"type"  :"service_account", "project": 7',
    f"AAAA{made(_MIXED + '-_', 35)}:{made(_MIXED + '-_', 92)}Q",
    "-".join(made(_HEX, n) for n in (8, 4, 4, 4, 12)),
    "postgresql://app:s3cr-t@pg-main:6432/sales",
    "mysql://report:r3port@sql.office.net:3307/",
    "mongodb://m1:m2@shard0:27018/logs",
    "redis://:open@cache.office.net:6380",
    "variable 'region'{default='eu'}",
    "{{resolve:secretsmanager:app/db:SecretString}}",
    "environment: - QUEUE_TOKEN=q1",
    f"Bearer  {made(_MIXED + '-', 14)}",
    f"ya29.{made(_MIXED + '-', 20)}",
    f"{made(_MIXED + '+/', 43)}=",
    f"5K{made('123456789ABCDEFGHJKLMNPQRSTUVWXYZ', 50)}",
    f"0x{made(_HEX + 'ABCDEF', 64)}",
    "ü640-17-2203",
    "5500-0000-0000-0004",
    f"ak-test-{made(_MIXED, 9)}",
    "your-key-here, or INSERT.HERE",
    f"sk-{made(_MIXED, 19)} AKIA{made(_UPPER, 15)} desk-{made(_MIXED, 24)}",
    "pwd: '' passphrase \"x\"",
    f"{_TOKEN} 8.8.4.4 it@dept.gov auth_token='t' sk-{made(_MIXED, 22)} AKIA{made(_DIGITS, 16)}",
)

# Paths for every context, among them none at all.
PATHS = (
    None,
    "/srv/app/.env",
    "D:\\app\\.env",
    "/srv/app/README.md",
    "/srv/app/test/secrets.txt",
    "D:\\app\\test\\secrets.txt",
    "/w/.env.example",
    "/w/src/__tests__/a.ts",
    "/w/a.spec.ts",
    "/w/testing/a.spec.ts",
    "/w/docs/a.md",
    "/w/notes/a.md",
    "/w/main.tf",
    "/w/k8s/a.yaml",
    "test/a.txt",
    "/w/templates/README.md",
    "/w/src/main.ts",
    "prod.env",
    "",
)


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: Sequence[str | None], index: str) -> Column:
    """The value at ``index`` (SQL) modulo the number of values."""
    options = ", ".join("string(NULL)" if v is None else lit(v) for v in values)
    return F.expr(f"get(array({options}), int(pmod({index}, {len(values)})))")


def pick_sql(values: Sequence[str | None], index: str) -> str:
    options = ", ".join(quoted(v) for v in values)
    return f"(list_value({options}))[(({index}) % {len(values)}) + 1]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are: ``(doc_id, source, lang, text)``."""
    return scan_corpus(
        spark, f"{sf_dir}/documents.parquet", ("doc_id", "source", "lang", "text"), "doc_id"
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a sample appended and a path assigned."""
    return documents(spark, sf_dir).select(
        "doc_id",
        "source",
        "lang",
        pick(PATHS, "doc_id").alias("path"),
        F.concat(F.col("text"), F.lit(" "), pick(SAMPLES, "doc_id")).alias("text"),
    )


DOCUMENTS_SQL = "SELECT doc_id, source, lang, text FROM documents"
PLANTED_SQL = (
    f"SELECT doc_id, source, lang, {pick_sql(PATHS, 'doc_id')} AS path, "
    f"text || ' ' || {pick_sql(SAMPLES, 'doc_id')} AS text FROM documents"
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as units ``(doc_id, source, text)``; the address host is the source."""
    df = scan_corpus(spark, f"{sf_dir}/pages.parquet", ("page_id", "url", "html"), "page_id")
    host = F.regexp_extract("url", r"^https?://([^/:]+)", 1)
    return df.select(F.col("page_id").alias("doc_id"), host.alias("source"), F.col("html").alias("text"))


PAGES_SQL = (
    "SELECT page_id AS doc_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS source, "
    "html AS text FROM pages"
)
