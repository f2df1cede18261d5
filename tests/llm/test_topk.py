import math
import random

import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import topk

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"
QUERY = lambda i: i % 20 == 0


def _expected(rows, k):
    vectors = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in vectors or v < vectors[i]:
            vectors[i] = v
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    out = []
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def _rows(n, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, 0.25, 0.1, r.uniform(-1, 1)]) for _ in range(8)], 0) for i in range(n)]
    # Ties, repeated ids, vectors that take no part, short, empty and large ones.
    rows += [(7, rows[7][1], 0), (21, rows[22][1], 0), (n, None, 0), (n + 1, [1.0, None], 0), (None, [1.0], 0)]
    rows += [(n + 2, [float("nan")] * 8, 0), (n + 3, [float("inf")], 0), (n + 4, [], 0), (n + 5, [0.5, 0.5], 0)]
    return rows + [(n + 6, [3e6] * 8, 0), (2 * n // 20 * 20, [-3e7] * 8, 0)]


def test_against_brute_force(spark):
    rows = _rows(300, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("v", F.lit(0))
    for k, shard, block in ((5, 40, 4), (20, 1024, 256)):
        got = topk.top_k(df, QUERY, k, shard_rows=shard, block_rows=block)
        assert sorted(map(tuple, got.collect())) == _expected(rows, k)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, QUERY).collect()] == [(0, 1, 1, 64 * 32)]


def test_exact_beyond_floating_point():
    a = np.array([[2**31, 1]])
    assert topk.products(a, a).tolist() == [[2**62 + 1]]
    big = np.array([[2**40, 3]])
    assert topk.products(big, big).tolist() == [[2**63 - 1]]


def test_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), QUERY).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), QUERY).count() == 0
