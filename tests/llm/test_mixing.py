import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .samples import SCHEMA, messy_rows, prose
from textwarden.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes):
    """Shares by weight, the excess over twice a size shared again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        for s in full or list(free):
            target[s] = 2.0 * sizes[s] if full else left * weight[s] / total
        left -= sum(target[s] for s in full)
        free -= set(full) if full else free
    return target


def _sizes(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    return sizes


@pytest.mark.parametrize("seed", [0, 1])
def test_messy_rows(messy, seed):
    rows = messy_rows()
    sizes = _sizes(rows)
    target = _targets(sizes)
    got = mixing.taken_words(messy, seed=seed).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    assert Counter(r.size for r in got) == Counter(len(WORD.findall(r[1] or "")) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(sizes[s], round(target[s], 6)) for s in sizes}


def test_taken_words_come_near_targets(spark):
    rows = [(i, prose(i, 50 + i % 400), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target, taken = _targets(_sizes(rows)), defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    first = mixing.taken_words(docs).collect()
    for r in first:
        taken[source[r.doc_id]] += r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2 * mixing.BLOCK_WORDS, 0.02 * target[s])
    assert sorted(first) == sorted(mixing.taken_words(docs.repartition(5)).collect())


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        rows = spark.range(n).withColumn("n", F.lit(n))
        got = [r[0] for r in rows.select(mixing.permuted("id", "n", F.lit("s"))).collect()]
        assert sorted(got) == list(range(n))


def test_shards_draw_by_weight(spark):
    wanted = spark.createDataFrame([("a", 300, 0), ("b", 100, 300), ("c", 0, 400)], "skey STRING, slots LONG, slots_before LONG")
    drawn = mixing.shard_draws(wanted, 50, 400, 200, seed=1).groupBy("skey").agg(F.sum("drawn").alias("n")).collect()
    n = {r.skey: r.n for r in drawn}
    assert sum(n.values()) == 50 * 200 and set(n) == {"a", "b"}
    assert abs(n["a"] - 7500) < 5 * (10_000 * 0.75 * 0.25) ** 0.5


def test_pieces_cover_blocks(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", "s", 0) for i in range(200)]
    pieces = mixing.mixture(spark.createDataFrame(rows, SCHEMA), block_words=16).collect()
    blocks = defaultdict(int)
    for p in pieces:
        blocks[p["pass"], p.block, p.slot] += p.words
    words = sum(_sizes(rows).values())
    assert all(n == 16 or b == words // 16 for (_, b, _), n in blocks.items())
    assert len({(k[0], k[1]) for k in blocks}) == len(blocks)


def test_documents(messy, nothing):
    rows = messy_rows()
    mixed = mixing.mix_documents(messy)
    assert mixed.columns == messy.columns
    whole = {tuple(WORD.findall(r[1] or "")) for r in rows}
    got = mixed.collect()
    assert got and all(any(set(WORD.findall(r.text)) <= set(w) for w in whole) for r in got)
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.taken_words(nothing).count() == 0


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "s", None)], SCHEMA)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.taken_words(docs).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
