"""Every registered query against its SQL twin, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return round(value, 6) if isinstance(value, float) else value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    ours = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert ours
        return
    relation = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert _rows(df.columns, ours) == _rows(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    listing = "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", listing], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-800:]
    assert done.stdout.split() == list(QUERIES)
