import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textwarden.llm import toxicity

from .samples import SCHEMA, messy_rows, prose

LABELS = "doc_id LONG, quality INT, toxic INT"


@pytest.fixture(scope="module")
def characters(spark):
    rows = [(i, f"you idiot, what a stupid loser and moron {prose(i, 20)}", "en", "s", 0) for i in range(50)]
    return toxicity.character_model(spark.createDataFrame(rows, SCHEMA))


def test_character_model(characters):
    assert np.allclose(np.exp(characters).sum(axis=2), 1)
    i, d = ord("i") - 96, ord("d") - 96
    assert characters[i, d, i] > characters[i, d, 24]


@pytest.mark.parametrize("hidden", ["1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "idiiiiot", "iiidiot", "!d10t", "i-d-1-0-t"])
def test_hidden_words_are_read(characters, hidden):
    assert toxicity.decode(hidden, characters) == "idiot"
    words, row = toxicity.restored_words(["fine", f"Oh {hidden.upper()}, no", ""], toxicity.Reader(characters))
    assert "idiot" in words and set(row) == {1}


def test_restore(characters):
    assert toxicity.restore("You M0R0N... 1D10T here", characters) == "you moron idiot here"
    assert toxicity.restore("Plain WORDS, and 2024 stay.", characters) == "plain words, and 2024 stay."
    assert toxicity.restore("", characters) == "" and toxicity.restore(None, characters) == ""


def test_decoding_is_the_best_reading(characters):
    """Against all readings of the lattice."""
    from itertools import product

    for stretch in ("m0r0n", "l0$3r", "b00b1e", "stupiiiid!", "s t u p 1 d"):
        best, found = -1e9, None
        for reading in product(*toxicity.lattice(stretch)):
            text, score, x, y = "".join(r[0] for r in reading), sum(r[1] for r in reading), 0, 0
            for c in text:
                score += characters[x, y, ord(c) - 96]
                x, y = y, ord(c) - 96
            score += characters[x, y, 0]
            if score > best:
                best, found = score, text
        assert toxicity.decode(stretch, characters) == found


def test_long_stretches(characters):
    assert len(toxicity.decode("a1" * 5000, characters)) == 10_000
    assert toxicity.decode("z" * 100_000, characters) in ("z", "zz")


def test_hidden_toxic_texts_are_scored(spark):
    rows = [(i, f"{prose(i, 40)} {'what an idiot and moron' if i % 4 == 0 else ''} {prose(i + 900, 20)}", "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], LABELS)
    model = toxicity.train(docs, labels)
    tests = ["what an 1d10t and m0r0n", "i d i o t and m o r o n", "a kind word here", "", None]
    new = spark.createDataFrame([(i, f"{prose(i + 5000, 30)} {t}" if t else t, "en", "s", 0) for i, t in enumerate(tests)], SCHEMA)
    got = {r.key: r.predicted for r in toxicity.score(new, model).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    assert sorted(r.doc_id for r in toxicity.keep_clean(new, model).collect()) == [2, 3, 4]


def _plain_features(texts, label, reader):
    """Features by counting them one by one."""
    rate, toxic_texts = {}, {}
    for i, t in enumerate(texts):
        features, words = toxicity._block_features([t], reader)
        counts = {}
        for _, f in features:
            for x in f.tolist():
                counts[x] = counts.get(x, 0) + 1
        for x, n in counts.items():
            rate.setdefault(x, {})[i] = np.log1p(100.0 * n / max(words[0], toxicity.LEAST_WORDS))
            toxic_texts[x] = toxic_texts.get(x, 0) + label[i]
    n, scored = [label.count(0), label.count(1)], []
    for x, values in rate.items():
        if toxic_texts[x] >= toxicity.LEAST_TEXTS:
            v = np.array([values.get(i, 0.0) for i in range(len(texts))])
            mean = [v[np.array(label) == j].mean() for j in (0, 1)]
            spread = sum(v[np.array(label) == j].var() / n[j] for j in (0, 1)) + 0.25 / (n[0] * n[1])
            z = abs(mean[1] - mean[0]) / np.sqrt(spread)
            if z >= toxicity.LEAST_Z:
                scored.append((-z, x))
    return [x for _, x in sorted(scored)]


@pytest.mark.parametrize("words", [4, 1 << 17])
def test_features_against_plain_counts(spark, monkeypatch, words):
    """Also with a bitmap far too small to tell features apart."""
    monkeypatch.setattr(toxicity, "BITMAP_WORDS", words)
    label = [int(i % 3 == 0) for i in range(120)]
    texts = [f"{prose(i % 17, 60)} {'you 1d10t and moron ' * (i % 5 == 0) if t else ''}{prose(i + 400, 60)}" for i, t in enumerate(label)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(label)], LABELS)
    model = toxicity.train(docs, labels)
    expected = _plain_features(texts, label, toxicity.Reader(toxicity.character_model(docs)))
    assert len(expected) > 5 and model.features.tolist() == sorted(expected[: toxicity.FEATURES])


def test_blocks_of_one_label(characters):
    marks = np.full(4, 2**64 - 1, np.uint64)
    for label in (0, 1):
        for texts in (["a few words"], [""], [None, "x"]):
            batch = pa.record_batch([pa.array([label] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["label", "text"])
            (out,) = toxicity._moments(iter([batch]), characters, marks)
            assert [str(t) for t in out.schema.types] == ["int64"] + ["double"] * 4
            assert sum(out.column(f"x{1 - label}").to_pylist()) == 0


def test_fit_in_blocks_is_the_fit(monkeypatch):
    r = np.random.default_rng(3)
    x = np.where(r.random((500, 12)) < 0.3, r.random((500, 12)), 0)
    y = (x @ r.normal(size=12) + r.normal(size=500) > 0).astype(float)
    row, place = np.nonzero(x)
    start = np.searchsorted(row, np.arange(501))
    w = toxicity._fit(y, start, place, x[row, place], 12)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 7)
    assert np.allclose(w, toxicity._fit(y, start, place, x[row, place], 12))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    held = np.append(toxicity.RIDGE * w[:-1], 1e-3 * w[-1])
    assert np.abs(np.append(x.T @ (p - y), (p - y).sum()) + held).max() < 1e-6  # nothing left to gain


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 1, 1), (3, 1, None), (7, 1, 0)], LABELS)
    for known in (labels, labels.filter("toxic = 0"), labels.filter(F.lit(False))):
        model = toxicity.train(messy, known)
        got = toxicity.score(messy, model).collect()
        assert len(got) == len(messy_rows()) and all(0 <= r.score <= 1 for r in got)
        kept = toxicity.keep_clean(messy, model)
        assert kept.columns == messy.columns and kept.count() == sum(not r.predicted for r in got)
    model = toxicity.train(nothing, labels)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.keep_clean(nothing, model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~out))
    got = toxicity.score(docs, model).join(labels.filter(out).withColumnRenamed("doc_id", "key"), "key").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.01


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [(i, f"you are a moron, I am an idiot, what a loser. {prose(i, 20)}", "en", "s", 0) for i in range(50)]
    return toxicity.character_model(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("text, word", [
    ("you are a m o r o n", "moron"), ("I a m a n i d i o t", "idiot"), ("what a i.d.i.o.t", "idiot"),
    ("m  o  r  o  n", "moron"), ("a  m  o  r  o  n", "moron"), ("m\to\tr\to\tn", "moron"), ("m, o, r, o, n", "moron"),
    ("m/o/r/o/n", "moron"), ("you a  r  e  a  m - 0 - r - o - n", "moron"), ("mmoorroonn", "moron"), ("mm00rroonn", "moron"),
])
def test_words_after_others_wide_gaps_and_doubled_letters(sentences, text, word):
    words, row = toxicity.restored_words(["x", text, "y z"], toxicity.Reader(sentences))
    assert word in words and set(row) == {1}
    assert word in toxicity.restore(text, sentences).split()


def test_gaps_end_with_the_row(sentences):
    assert toxicity.restored_words(["m", "o", "r o", "n"], toxicity.Reader(sentences)) == ([], [])
