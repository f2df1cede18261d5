import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import suffix_dedup as S

from .samples import SCHEMA, messy_rows, prose


def _expected(rows):
    """By a table of all strings, in document order; rows of one id are no repeats of each other."""
    out, seen = [], set()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    at = 0
    while at < len(order):
        same = [r for r in order[at:] if r[0] == order[at][0]]
        at += len(same)
        added = set()
        for row in same:
            data = (row[1] or "").encode()
            gone, own = np.zeros(len(data), bool), set()
            for p in range(len(data) - S.LENGTH + 1):
                part = data[p : p + S.LENGTH]
                if part in seen or part in own:
                    gone[p : p + S.LENGTH] = True
                own.add(part)
            added |= own
            kept = bytes(b for b, g in zip(data, gone) if not g)
            spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
            out.append((row[0], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        seen |= added
    return sorted(out, key=repr)


def _check(df, rows):
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(df).collect()), key=repr)
    assert got == _expected(rows)


def _rows(seed, n=120):
    """Few words, shared passages of many lengths, overlaps, copies, repeats within a text."""
    r = random.Random(seed)
    shared = [prose(1000 + i, r.randrange(8, 60)) for i in range(12)]
    rows = []
    for i in range(n):
        parts = [prose(r.randrange(200), r.randrange(3, 40)) for _ in range(3)] + r.choices(shared, k=r.randrange(0, 4))
        if r.random() < 0.2:
            s = r.choice(shared)
            parts.append(s[r.randrange(20) :])
        if r.random() < 0.1:
            parts.append("ab" * r.randrange(30, 200))
        r.shuffle(parts)
        rows.append((i, " ".join(parts), "en", "s", 0))
    rows += [(n + i, rows[i][1], "de", "s", 0) for i in range(5)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_table_of_strings(spark, seed):
    rows = _rows(seed)
    _check(spark.createDataFrame(rows, SCHEMA), rows)


def test_messy(spark, messy, nothing):
    _check(messy, messy_rows())
    assert S.remove_repeats(nothing).count() == 0
    short = [(1, "x" * 99, None, None, 0), (2, "x" * 99, None, None, 0), (3, None, None, None, 0)]
    _check(spark.createDataFrame(short, SCHEMA), short)


def test_rows_without_id_whose_hashes_share_32_bits(spark):
    """As a mark, 32 bits would take two of 200 000 such rows for one."""
    passage = prose(7, 40)[:180]
    made = spark.range(200_000).select(F.concat(F.col("id").cast("string"), F.lit(" " + passage)).alias("text"))
    low = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    pair = made.groupBy(low.alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t
    rows = [(1, passage, "en", "s", 0), *((None, t, "en", "s", 0) for t in pair)]
    _check(spark.createDataFrame(rows, SCHEMA), rows)


def test_binary_like_text(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("\x00\x01a", k=400)) + "\x00" * r.randrange(90, 230), None, None, 0) for i in range(20)]
    rows += [(30 + i, rows[i][1][37:300] + "é" * 70, None, None, 0) for i in range(10)]
    _check(spark.createDataFrame(rows, SCHEMA), rows)


def test_long_texts_are_cut_without_loss(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 100, 5000).astype(np.uint8).tobytes()
    p = S.passages(np.frombuffer(data, np.uint8), np.array([len(data)]))
    whole = {a - o for a, low, high in zip(p.at, p.low, p.high) for o in range(low, high + 1)}
    assert whole == set(range(len(data) - S.LENGTH + 1))
    monkeypatch.setattr(S, "SEGMENT", 700)
    starts, cores = set(), set()
    for part, ends, text, offset in S._stretches([data]):
        q = S.passages(part, ends)
        starts |= {a + offset[0] - o for a, low, high in zip(q.at, q.low, q.high) for o in range(low, high + 1)}
        cores |= set(zip((q.at + offset[0]).tolist(), q.core.tolist()))
    assert starts == whole and cores == set(zip(p.at.tolist(), p.core.tolist()))


@pytest.mark.parametrize("shallow", [8, 32])
def test_deep_shallow_order(shallow):
    r = random.Random(9)
    strings, group = [], []
    for g in range(40):
        stem = bytes(r.choices(b"ab", k=r.randrange(0, 90)))
        for _ in range(r.randrange(1, 30)):
            strings.append((stem + bytes(r.choices(b"ab", k=r.randrange(0, 40))))[: r.randrange(1, 110)])
            group.append(g)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    got = S.deep_shallow(flat, start, size, np.array(group), shallow)
    width = int(size.max())
    padded = [s.ljust(width, b"\0") for s in strings]
    order = got.order.tolist()
    assert sorted(order) == list(range(len(strings)))
    assert [(group[i], padded[i]) for i in order] == sorted(zip(group, padded))
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if group[i] == group[j]:
            same = next((x for x in range(width) if padded[i][x] != padded[j][x]), width)
            assert got.common[k] == same


def test_merge():
    assert S.merge(np.array([5, 0, 30]), np.array([12, 6, 31])) == [(0, 12), (30, 31)]
    assert S.merge(np.array([0, 3]), np.array([3, 4])) == [(0, 4)]
    assert S.merge(np.zeros(0, int), np.zeros(0, int)) == []
