import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import whitening

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def _expected(rows, k):
    """By another way: all values at once by numpy, sums by Python numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    whole = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) + (1_000_000,) * (width - len(v))) for i, v in kept]
    fit = sorted({x for _, x in whole})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = np.var(centred, axis=0).sum()
    out = []
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        w = np.array([(n * c - s) / n for c, s in zip(x, total)]) @ vectors / np.sqrt(values)
        out.append((i, n, deviation, w, values / trace))
    return out


def _rows(n, width, seed):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 + c) + r.gauss(0, 3) for c in range(width)]) for i in range(n)]
    rows += [(n, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]  # a copy, an id twice, no id
    return rows + [(n + 1, None), (n + 2, [1.0] * (width - 1) + [None]), (n + 3, [float("nan")] * width), (n + 4, [float("-inf")])]


@pytest.mark.parametrize("n, width, k", [(400, 24, 16), (60, 5, 16), (300, 12, 3)])
def test_against_numpy(spark, n, width, k):
    rows = _rows(n, width, n)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).select("*", F.lit("?").alias("key"), F.lit("?").alias("x"), F.lit(1).alias("n"))
    got = whitening.whiten(df, k).collect()
    expected = _expected(rows, k)
    assert len(got) == len(expected) * min(k, width)
    assert all(r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1
    order = lambda i: (i is None, i or 0)
    columns = {}
    for c in range(1, min(k, width) + 1):
        own = [r for r in got if r["component"] == c]
        assert sorted(((r["vec_id"], r["n"], r["deviation"]) for r in own), key=lambda r: (order(r[0]), r)) == sorted(
            ((i, n_, d) for i, n_, d, _, _ in expected), key=lambda r: (order(r[0]), r)
        )
        assert all(abs(r["explained"] - expected[0][4][c - 1]) < 1e-9 for r in own)
        columns[c] = own
        mine = sorted(round(r["whitened"], 6) for r in own)
        theirs = sorted(round(e[3][c - 1], 6) for e in expected)
        turned = sorted(round(-e[3][c - 1], 6) for e in expected)
        assert np.allclose(mine, theirs, atol=1e-5) or np.allclose(mine, turned, atol=1e-5)


def test_eigenpairs_of_clusters():
    r = np.random.default_rng(5)
    for spectrum in ([9, 9, 9, 1, 1, 0.5, 0, 0], [5.0] * 6, [1e6, 1e6 + 1e-6, 1e-3, 1e-3, 0, 0, 0], [4, 3, 2, 1], [2.5], [7, 7]):
        q, _ = np.linalg.qr(r.normal(size=(len(spectrum), len(spectrum))))
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        for k in (1, len(spectrum)):
            values, vectors = whitening.leading_pairs(a, k)
            assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-9 * max(spectrum))
            assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
            assert np.allclose(a @ vectors, vectors * values, atol=1e-9 * max(spectrum))
    # Already diagonal or tridiagonal: reflections have nothing to do, couplings are zero.
    values, vectors = whitening.leading_pairs(np.diag([3.0, 3.0, 1.0, 2.0]), 4)
    assert np.allclose(values, [3, 3, 2, 1]) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_sturm_counts():
    r = np.random.default_rng(1)
    d, e = r.normal(size=30), r.normal(size=29)
    e[[4, 17]] = 0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = r.normal(size=200) * 2
    assert whitening.sturm_count(d, e, at).tolist() == [(true < x).sum() for x in at]


def test_same_however_dealt(spark):
    df = spark.createDataFrame([(i, v, 0) for i, v in _rows(200, 9, 4)], SCHEMA)
    key = lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["whitened"])
    one, many = (sorted(whitening.whiten(df.repartition(p), 4).collect(), key=key) for p in (1, 7))
    for a, b in zip(one, many, strict=True):
        assert (a["deviation"], a["explained"]) == (b["deviation"], b["explained"])
        assert abs(a["whitened"] - b["whitened"]) < 1e-12


def test_few_short_and_huge(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    # [1] and [1, 0] are one vector; two vectors have one component.
    got = whitening.whiten(make([(1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == [
        (i, 1, 2, 64**2 + (3 * 64) ** 2) for i in (1, 2, 3)
    ]
    assert {round(abs(r["whitened"]), 9) for r in got} == {1.0} and got[0]["explained"] == pytest.approx(1)
    huge = whitening.whiten(make([(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.0, 7.0])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {2**63 - 1}
