import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import langid

from .samples import SCHEMA, messy_rows

WORDS = {
    "en": "the of and that with this from which there would about after where",
    "de": "der die und nicht eine durch werden zwischen auch über schon können",
    "fr": "les des dans pour avec cette être toujours même après où jusque",
}


def _texts(lang, n, seed):
    r = np.random.default_rng(seed)
    words = WORDS[lang].split()
    return [" ".join(r.choice(words, 40)) for _ in range(n)]


def _model(spark):
    rows = [(i, t, lang, "s", 0) for lang in WORDS for i, t in enumerate(_texts(lang, 20, 1))]
    return langid.train(spark.createDataFrame(rows, SCHEMA))


def test_main_language_and_shares(spark):
    model = _model(spark)
    en, de = _texts("en", 1, 5)[0].split(), _texts("de", 1, 6)[0].split()
    rows = [(0, " ".join(en), None, None, 0), (1, " ".join(en[:10] + de[:30]), None, None, 0), (2, "les, DANS! toujours", None, None, 0)]
    got = {r.key: r for r in langid.predict(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert (got[0].lang_pred, len(got[0].mixture)) == ("en", 1)
    assert got[1].lang_pred == "de" and abs(got[1].score - 0.75) < 0.05
    assert {m.lang for m in got[1].mixture} == {"en", "de"}
    assert got[2].lang_pred == "fr" and got[2].score == 1.0


def test_estimation_never_gets_less_likely():
    r = np.random.default_rng(0)
    log_p = r.normal(-3, 2, (200, 4)).astype(np.float32)
    count = np.array([50, 1, 149])
    start = np.array([0, 50, 51])
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    share = np.full((3, 4), 0.25, np.float32)
    before = None
    for _ in range(5):
        after, likelihood = langid._estimate(p, count, start, share)
        assert before is None or (likelihood >= before - 1e-3).all()
        before, share = likelihood, after.astype(np.float32)
    assert np.allclose(after.sum(axis=1), 1, atol=1e-4)


def test_messy(spark, messy, nothing):
    model = _model(spark)
    got = langid.predict(messy, model).collect()
    assert len(got) == len(messy_rows())
    unknown = {r.key for r in got if r.lang_pred == "und"}
    assert unknown == {4, 5, 6, None} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(nothing, model).count() == 0


def test_nothing_to_learn_from(spark, messy, nothing):
    model = langid.train(messy.withColumn("lang", F.lit(None).cast("string")))
    assert model.languages == []
    assert {r.lang_pred for r in langid.predict(messy, model).collect()} == {"und"}
    assert langid.train(nothing).languages == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.filter(rest != 1))
    got = langid.predict(docs.filter(rest == 1), model).join(docs.select(F.col("doc_id").alias("key"), "lang"), "key")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.98
