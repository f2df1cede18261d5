"""What the plans must look like: no needless shuffle, no regex run twice, narrow scans."""

import re

import pytest

from textwarden.functions.detect import detect_labels
from textwarden.functions.risk import score_units
from textwarden.functions.rewrite import sanitize_corpus
from textwarden.operators.gate import alerts, gate_verdict
from textwarden.operators.spans import span_positions
from textwarden.operators.stats import risk_summary, rule_hit_stats


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    spark.range(200).selectExpr(
        "id AS doc_id", "concat('s', id % 3) AS source", "concat('/w/', id, '.md') AS path",
        "concat('x ', id, ' 1.2.3.', id) AS text", "'A' AS change_type", "id AS unused",
    ).repartition(9).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, needle=r"RLIKE\(text#\d+, \(\?=\[s\]\)\(\?<!\[A-Za-z0-9_\]\)sk\\-ant"):
    return len(re.findall(needle, plan(df)))


@pytest.mark.parametrize(
    "build",
    [
        detect_labels,
        lambda df: score_units(df, path="path"),
        lambda df: alerts(score_units(df, path="path")),
        lambda df: score_units(df, path="path").filter("level = 'HIGH' AND score > 70"),
        span_positions,
    ],
)
def test_scans_are_narrow_and_run_once(corpus, build):
    df = build(corpus)
    assert "Exchange" not in plan(df)
    assert scans(df) == 1


def test_a_filter_on_changed_does_not_rewrite_twice(corpus):
    df = sanitize_corpus(corpus).filter("changed").select("doc_id", "sanitized")
    text = plan(df)
    assert "Exchange" not in text
    assert text.count("<ANTHROPIC_API_KEY>") == 1


def test_summaries_combine_before_they_shuffle(corpus):
    for df in (
        risk_summary(score_units(corpus)),
        rule_hit_stats(corpus, ("source",)),
        gate_verdict(corpus.withColumnRenamed("source", "change_id")),
    ):
        text = plan(df)
        assert text.count("Exchange") == 1 and text.count("partial_") >= 1
        above = text.split("Exchange")[0]
        assert "RLIKE" not in above


def test_only_the_columns_asked_for_are_read(corpus):
    df = risk_summary(score_units(corpus.select("source", "text")))
    schema = re.search(r"ReadSchema: (\S+)", plan(df)).group(1)
    assert schema == "struct<source:string,text:string>"


def test_filters_reach_the_file(corpus):
    df = score_units(corpus).filter("source = 's1'").select("doc_id", "score")
    text = plan(df)
    assert "EqualTo(source,s1)" in text and scans(df) == 1
