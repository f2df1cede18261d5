import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import odd_sketch
from textwarden.llm.components import components
from textwarden.llm.odd_sketch import Settings

from .samples import SCHEMA, messy_rows, prose

THREE = Settings(words=3, least=85)


def _set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _expected(rows, settings):
    sets = [_set(r[1], settings.words) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and settings.of * both >= settings.least * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    ids = {}
    for i, row in enumerate(rows):
        ids.setdefault(find(i), []).append(row[0])
    out = []
    for i, row in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        first = min(known) if known else None
        out.append((row[0], len(sets[i]), first, row[0] == first))
    return sorted(out, key=repr)


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def _edited(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("settings", [THREE._replace(small=2), Settings()])
def test_groups_and_chains(spark, settings):
    r = random.Random(5)
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(60)]
    for group in range(3):  # larger than a small bucket, edited by different amounts
        base = prose(1000 + group, 150).split()
        rows += [(100 + 40 * group + i, _edited(base, i % 7, r), "en", "s", 0) for i in range(40)]
    chain = prose(77, 200).split()
    for i in range(25):  # each link is close, the ends are far apart
        chain = _edited(chain, 3, r).split()
        rows.append((400 + i, " ".join(chain), "en", "s", 0))
    r.shuffle(rows)
    assert _got(odd_sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings)) == _expected(rows, settings)


def test_messy(messy, nothing):
    for settings in (THREE, Settings()):
        got = odd_sketch.near_duplicates(messy, settings)
        assert _got(got) == _expected(messy_rows(), settings)
        kept = odd_sketch.keep_one(messy, settings)
        assert kept.columns == messy.columns
        assert kept.count() == len({(r.doc_id, r.hash) for r in got.collect() if r.first})
        assert odd_sketch.near_duplicates(nothing, settings).count() == 0
        assert odd_sketch.keep_one(nothing, settings).count() == 0


def test_texts_without_words_only(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, None, 0)], SCHEMA)
    assert _got(odd_sketch.near_duplicates(docs)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_sketches_count_differing_samples():
    r = np.random.default_rng(1)
    samples = r.integers(0, 2**62, (2, 128), dtype=np.uint64)
    samples[1, :118] = samples[0, :118]
    a, b = odd_sketch.odd_sketches(samples, 512)
    bits = sum(int(x).bit_count() for x in a ^ b)
    assert bits <= 20 and bits % 2 == 0 and bits >= 14
    assert (odd_sketch.odd_sketches(samples, 512) == [a, b]).all()


def test_samples_agree_like_sets():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**62, 400, dtype=np.uint64)
    other = base.copy()
    other[:40] = r.integers(0, 2**62, 40, dtype=np.uint64)
    settings = Settings(bands=500, rows=4)
    a, b = odd_sketch.signatures([np.unique(base), np.unique(other)], settings)
    assert abs((a == b).mean() - 360 / 440) < 0.05


def test_limit_keeps_links():
    """A pair at the least similarity passes the sketches with odds beyond six deviations."""
    for settings in (THREE, Settings()):
        k, j = settings.samples, settings.least / settings.of
        assert settings.most_bits >= 2 * k * (1 - j) + 6 * 2 * (k * j * (1 - j)) ** 0.5


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 150)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)]
    label = {}
    for a, b in links:
        label.setdefault(a, {a}), label.setdefault(b, {b})
        joined = label[a] | label[b]
        for x in joined:
            label[x] = joined
    got = {row.node: row.label for row in components(spark.createDataFrame(links, "a INT, b INT")).collect()}
    assert got == {x: min(s) for x, s in label.items()}
    assert components(spark.createDataFrame([], "a INT, b INT")).count() == 0


def test_no_node_is_lost(spark):
    docs = spark.createDataFrame([(i, prose(i % 50, 30), "en", "s", 0) for i in range(500)], SCHEMA)
    got = odd_sketch.near_duplicates(docs)
    assert got.count() == 500 and got.filter("kept").count() == 50
    assert got.agg(F.max("component_id")).first()[0] == 49


@pytest.mark.parametrize("words", [3, 5])
def test_short_texts_alone_in_their_block(spark, words):
    texts = [" ".join("abcdef"[:n]) for n in range(7)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartitionByRange(7, "doc_id")
    got = {r.key: r.n for r in odd_sketch.describe(docs, Settings(words=words, least=80)).collect()}
    assert got == {n: len(_set(texts[n], words)) for n in range(7)}
    assert all(len(odd_sketch.shingle_sets([t], words)[0]) == len(_set(t, words)) for t in texts)
