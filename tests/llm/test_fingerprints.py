import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import fingerprints as fp

from .samples import SCHEMA, prose

M = 2**64 - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def _coin(own, left):
    differ = own ^ left
    place = (differ & -differ).bit_length() - 1
    return 2 * place + (own >> place & 1)


def _parse(text):
    """All phrases ``(name, length)`` of a text, symbol by symbol."""
    spread, step = int(fp._SPREAD), int(fp._STEP)
    row, out = [(_mix(ord(c) + step & M), 1) for c in text], []
    while row:
        joined = []
        for name, length in row:
            if joined and joined[-1][0] == name:
                joined[-1] = (name, joined[-1][1], joined[-1][2] + 1)
            else:
                joined.append((name, length, 1))
        row = [(_mix((n * spread & M) + k & M) if k > 1 else n, length * k) for n, length, k in joined]
        label = [n for n, _ in row]
        for _ in range(4):
            label = [label[0] & 1] + [_coin(b, a) for a, b in zip(label, label[1:])]
        starts = [0] + [i for i in range(2, len(row) - 1) if label[i - 1] < label[i] > label[i + 1]]
        after = []
        for a, b in zip(starts, [*starts[1:], len(row)]):
            name = row[a][0]
            for n, _ in row[a + 1 : b]:
                name = (name * spread + n) & M
            after.append((_mix((name + (b - a) * step) & M), sum(length for _, length in row[a:b])))
        out += after
        row = after if len(after) > 1 else []
    return out


def _sketch(text):
    bins = {}
    for name, length in _parse(text):
        at = -np.log(((name >> 11) + 0.5) * 2.0**-53) / length
        own = name & fp.BINS - 1
        if own not in bins or at < bins[own][0]:
            bins[own] = at, (_mix((name + int(fp._STEP)) & M) >> 64 - fp.TAG_BITS) + 1
    return [bins.get(b, (0, 0))[1] for b in range(fp.BINS)]


TEXTS = ["", "a", "ab", "aa", "aaaaaaaaaaa", "abababababab", "漢字\U0001F600 x", prose(3, 50), prose(4, 400), "x" * 3000 + prose(5, 9), "\x00\n"]


def test_against_plain_parse():
    got = fp.fingerprints(TEXTS)
    for text, line in zip(TEXTS, got.tolist()):
        assert line == _sketch(text)
    phrases = {}
    for doc, name, length in fp.phrases(TEXTS):
        for d, n, k in zip(doc.tolist(), name.tolist(), length.tolist()):
            phrases.setdefault(d, []).append((n, k))
    for i, text in enumerate(TEXTS):
        assert phrases.get(i, []) == _parse(text)
        if text:
            assert phrases[i][-1][1] == len(text)  # the whole


def test_the_same_in_any_block(monkeypatch):
    whole = fp.fingerprints(TEXTS)
    monkeypatch.setattr(fp, "BLOCK_CHARS", 10)
    assert (fp.fingerprints(TEXTS) == whole).all()
    assert (fp.fingerprints(TEXTS[::-1])[::-1] == whole).all()


def test_labels_differ_between_neighbours():
    r = np.random.default_rng(2)
    names = r.integers(0, 2**63, 5000, dtype=np.uint64)
    names[100:200] = (np.arange(100, dtype=np.uint64) << np.uint64(40)) + np.uint64(7)  # equal low bytes
    head = np.zeros(5000, bool)
    head[[0, 1, 2, 150, 4999]] = True
    label = fp.labels(names, head)
    assert label.max() < 6 and (label[1:] != label[:-1])[~head[1:]].all()


def test_equal_substrings_share_their_interior():
    common = prose(11, 300)
    for before, after in (("", ""), ("x", "yy"), (prose(12, 40), prose(13, 70)), ("a" * 999, "")):
        a = {n for n, k in _parse(common) if 16 <= k < 200}
        b = {n for n, _ in _parse(before + common + after)}
        # Only phrases within a few symbols of an edge on their level may differ.
        assert len(a & b) > 0.75 * len(a)
    assert fp.likeness(fp.fingerprints([common]), fp.fingerprints([prose(99, 300)]))[0] < 0.2


def test_likeness_estimates_the_common_part():
    errors = []
    for seed in range(40):
        a, b = prose(seed, 300), prose(1000 + seed, 300)
        changed = fp.edited(a, b)
        x, y = (dict(_parse(t)) for t in (a, changed))
        both, common = np.zeros(fp.BINS), np.zeros(fp.BINS)
        for name, length in (x | y).items():
            both[name % fp.BINS] += length
            common[name % fp.BINS] += length * (name in x and name in y)
        true = np.mean(common[both > 0] / both[both > 0])
        s = fp.fingerprints([a, changed])
        errors.append(fp.likeness(s[:1], s[1:])[0] - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def _expected(rows):
    """Rows in falling order; those without id last, ties by any order the operator may take."""
    out = {}
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        mine, its, following = (fp.as_text(fp.fingerprints([t]))[0] for t in (text, changed, after))
        out[key] = len(text), hashlib.sha256(changed.encode()).hexdigest(), mine, its, following
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_order_and_borders(spark, parts):
    r = random.Random(parts)
    rows = [(i * 3, r.choice([prose(i, r.randint(0, 60)), None, "", "ab", prose(5, 2000)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("?").alias("key"), F.lit(1).alias("part"), F.lit(2).alias("edge"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {g["doc_id"]: g for g in fp.compare_edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = _expected(rows[::-1])
    assert got.keys() == expected.keys()
    parsed = lambda t: np.array([[0 if t[i : i + 4] == "...." else int(t[i : i + 4], 16) + 1 for i in range(0, 256, 4)]])
    for key, (size, sha, mine, its, following) in expected.items():
        g = got[key]
        assert (g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) == (size, sha, mine, its)
        assert g["near_edited"] == fp.likeness(parsed(mine), parsed(its))[0]
        assert g["near_next"] == fp.likeness(parsed(mine), parsed(following))[0]


def test_messy(spark, messy, nothing):
    assert fp.compare_edited(nothing).count() == 0
    got = fp.compare_edited(messy).collect()
    assert len(got) == messy.count()
    assert sorted(g["n_chars"] for g in got) == sorted(len(r["text"] or "") for r in messy.select("text").collect())
    by_text = {}
    for g in got:
        by_text.setdefault((g["doc_id"], g["n_chars"]), set()).add(g["fingerprint"])
    assert all(len(prints) == 1 for (key, _), prints in by_text.items() if key is not None)
    only = fp.compare_edited(spark.createDataFrame([(1, "abcdefghi", "en", "s", 9)], SCHEMA)).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and only["near_next"] == 1.0
    empty = fp.compare_edited(spark.createDataFrame([(1, "", "en", "s", 9), (2, None, "en", "s", 9), (3, "x", "en", "s", 9)], SCHEMA))
    assert {g["doc_id"]: (g["near_edited"], g["near_next"]) for g in empty.collect()} == {1: (1.0, 0.0), 2: (1.0, 1.0), 3: (1.0, 0.0)}
