import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textwarden.llm import odd_sketch

from .samples import CLASHING

SF_DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "source mixing", "sentence pieces"]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_each_stage_acts_on_what_is_left(spark, outputs):
    docs, clean, distinct, unlike, mixed, last = outputs
    assert all(df.columns == docs.columns for df in (clean, distinct, unlike, mixed))
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert 0 < len(rows) < docs.count()
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    first = {}
    for i in sorted(rows):
        first.setdefault(digest(rows[i]), i)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(first.values())
    near = odd_sketch.near_duplicates(distinct, corpus_pipeline.NEAR).filter("kept")
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in unlike.collect())
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    before = {r.source: r.n for r in unlike.groupBy("source").agg(words.alias("n")).collect()}
    after = {r.source: r.n for r in mixed.groupBy("source").agg(words.alias("n")).collect()}
    assert all(after[s] <= 2 * before[s] for s in after)
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.02 * sum(before.values())
    assert mixed.filter("n_chars <> length(text)").isEmpty()
    assert last.filter("sample = 1").count() == mixed.count()


def test_run_agrees_in_kind(spark, outputs):
    assert corpus_pipeline.run(spark, SF_DIR).columns == outputs[-1].columns


def test_stages_on_messy_and_empty_documents(spark, messy, nothing):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (messy.select(*names, *CLASHING[:6]), nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()
