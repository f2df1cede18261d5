import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import resample

from .samples import SCHEMA, messy_rows, prose


def test_nth_highest(spark):
    r = np.random.default_rng(0)
    values = [float(x) for x in r.normal(0, 100, 3000)] + [5.0] * 500 + [1e9, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    for n in (1, 2, 17, 1500, len(values)):
        assert resample.nth_highest(df, "x", n) == sorted(values, reverse=True)[n - 1]
    assert resample.nth_highest(df, "x", 0) is None and resample.nth_highest(df, "x", 10**6) is None


def test_buckets_of_words_and_pairs():
    bucket, row = resample.gram_buckets(["A b c", "", "a  b", "c"])
    per = [sorted(bucket[row == i]) for i in range(4)]
    assert [len(p) for p in per] == [5, 0, 3, 1]
    assert set(per[2]) < set(per[0]) and set(per[3]) < set(per[0])


def test_weights_match_a_plain_count(spark):
    raw = [prose(i, 30) for i in range(30)]
    target = [prose(i, 30) for i in range(5)]
    rows = lambda ts: spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ts)], SCHEMA)

    def model(texts):
        n = np.bincount(resample.gram_buckets(texts)[0], minlength=resample.BUCKETS) + resample.SMOOTH
        return np.log(n / n.sum())

    ratio = model(target) - model(raw)
    expected = [ratio[resample.gram_buckets([t])[0]].sum() for t in raw]
    got = {r.key: r.log_weight for r in resample.log_weights(rows(raw), rows(target)).collect()}
    assert np.allclose([got[i] for i in range(30)], expected)


def test_likely_texts_are_taken(spark):
    rows = [(i, prose(i, 60) if i % 2 else "noise " * 60, "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = resample.resample(docs, docs.filter("doc_id % 2 = 1 AND doc_id < 40"), share=0.4).collect()
    assert sum(r.selected for r in got) == 80 and all(r.doc_id % 2 for r in got if r.selected)
    again = resample.resample(docs.repartition(3), docs.filter("doc_id % 2 = 1 AND doc_id < 40"), share=0.4).collect()
    assert sorted(got) == sorted(again)


def test_noise_alone_is_a_fair_sample(spark):
    docs = spark.createDataFrame([(i, None, None, None, None) for i in range(2000)], SCHEMA)
    taken = [r.doc_id for r in resample.resample(docs, docs, share=0.25).collect() if r.selected]
    assert len(taken) == 500 and abs(np.mean(taken) - 1000) < 5 * 577 / 500**0.5


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id LONG, quality INT, toxic INT")
    target = resample.target_rows(messy, labels)
    assert [r.doc_id for r in target.collect()] == [1]
    got = resample.resample(messy, target, share=0.5).collect()
    assert len(got) == len(messy_rows()) and sum(r.selected for r in got) >= 8
    assert all(r.log_weight == 0 for r in got if r.doc_id in (4, 5, 6))
    assert resample.resample(nothing, nothing).count() == 0
    assert resample.resample(messy, nothing).count() == len(got)
    assert resample.target_rows(messy, labels.filter(F.lit(False))).count() == 0
