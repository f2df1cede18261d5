import pytest
from pyspark.sql import functions as F

from textwarden.functions.rewrite import sanitize_corpus
from textwarden.sources.corpus import (
    blank_gate, changed_only, exclude_globs, glob_regex, ignore_paths, is_excluded, scan_corpus, scan_files,
    size_gate, spread, with_size_status, write_clean_copy,
)


def test_files_become_units(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("é 1.2.3.4".encode())
    (tmp_path / "a" / "bad.txt").write_bytes(b"ok \xff end")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    (tmp_path / "a.ts").write_text("let a")
    rows = {r.path.rsplit("/", 1)[1]: r for r in scan_files(spark, str(tmp_path), "*.txt", 50).collect()}
    assert set(rows) == {"x.txt", "bad.txt"}
    assert rows["x.txt"].text == "é 1.2.3.4" and rows["bad.txt"].text == "ok \ufffd end"


def test_only_changes_that_bring_content(spark):
    rows = [("A", "a"), ("D", "b"), ("M", " "), ("R", "c"), ("C", "d"), ("T", "e"), ("M", None)]
    df = spark.createDataFrame(rows, "change_type STRING, path STRING")
    assert sorted(r.path for r in changed_only(df).collect()) == ["a", "c", "d"]


def test_size_is_counted_in_bytes_and_the_limit_is_kept(units):
    df = units(["é" * 5, "é" * 5 + "x", "", None])
    assert sorted(r.doc_id for r in size_gate(df, 10).collect()) == [0, 2, 3]
    status = {r.doc_id: r.status for r in with_size_status(df, 10).collect()}
    assert status == {0: "OK", 1: "TOO_LARGE", 2: "OK", 3: "OK"}


def test_blank_means_all_white_space(units):
    df = units(["", " \t\n", "\u00a0\u2003\ufeff", " x ", None, "\u200b"])
    assert sorted(r.doc_id for r in blank_gate(df).collect()) == [3, 5]


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("**/*.env", "/a/b/x.env", True), ("*.env", "x.env", True), ("*.env", "a/x.env", False),
        ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**", "src/a/b.ts", True),
        ("a?c", "abc", True), ("a.c", "abc", False), ("C:/x/*", "C:\\x\\y", True), ("[a]", "[a]", True),
        ("a+(b)", "a+(b)", True),
    ],
)
def test_globs(units, glob, path, hit):
    row = units([("", path)]).select(is_excluded(F.col("path"), [glob]).alias("x")).first()
    assert row.x is hit


def test_legacy_globs_keep_the_star_as_a_quantifier(units):
    assert glob_regex("*.env", legacy=True) is None
    assert glob_regex("**/a", legacy=True) is None
    df = units([("", "src.ts"), ("", "src///.ts"), ("", "src/a.ts"), ("", None)])
    kept = exclude_globs(df, ["src/*.ts", "*.bad"], legacy=True)
    assert [r.path for r in kept.orderBy("doc_id").collect()] == ["src/a.ts", None]


def test_ignored_paths_are_per_owner(spark):
    df = spark.createDataFrame([("o", "a"), ("o", "b"), ("p", "a"), ("p", None)], "owner STRING, path STRING")
    ignored = spark.createDataFrame([("o", "a"), ("o", "a")], "owner STRING, path STRING")
    kept = ignore_paths(df, ignored).collect()
    assert sorted((r.owner, r.path or "") for r in kept) == [("o", "b"), ("p", ""), ("p", "a")]


def test_clean_copy_holds_no_original(spark, units, tmp_path):
    out = str(tmp_path / "clean")
    write_clean_copy(sanitize_corpus(units(["1.2.3.4", "x"])), out)
    back = spark.read.parquet(out)
    assert set(back.columns) == {"doc_id", "changed", "text"}
    assert sorted(r.text for r in back.collect()) == ["<IP_ADDRESS>", "x"]


def test_small_tables_are_spread_and_large_ones_left_alone(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(20).write.option("maxRecordsPerFile", 2).parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    assert scan_corpus(spark, str(tmp_path / "one"), key="id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many, "id") is many
