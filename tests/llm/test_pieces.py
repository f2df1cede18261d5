import hashlib
import itertools
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from textwarden.llm import pieces, textnum
from textwarden.llm.queries import VOCABULARY_PATH

from .samples import SCHEMA, messy_rows, prose

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY_PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def small():
    """A vocabulary of few pieces; ids 0 to 255 are bytes."""
    own = [pieces.chr(9601) if False else "▁", "a", "b", "ab", "▁a", "ba", "aba"]
    names = [f"<0x{b:02X}>" for b in range(256)] + own
    log_p = np.concatenate([np.full(256, -9.0), -np.arange(1, len(own) + 1) / 2])
    return pieces.vocabulary(names, list(range(256, len(names))), log_p, np.arange(256, dtype=np.int32))


@pytest.fixture(scope="module")
def real():
    return pieces.read_vocabulary(VOCABULARY_PATH)


def _seeds(n):
    return textnum.mixed(np.arange(n, dtype=np.uint64) + np.uint64(7))


def _all(text, vocab):
    """Every segmentation and its probability, by plain search."""
    signs = "▁" + text.replace(" ", "▁")
    found = {}

    def grow(at, ids, weight):
        if at == len(signs):
            found[tuple(ids)] = weight
        for i in range(256, len(vocab.pieces)):
            if signs.startswith(vocab.pieces[i], at):
                grow(at + len(vocab.pieces[i]), [*ids, i], weight + vocab.log_p[i])

    grow(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["ab", "abab a", "ba  aba"])
def test_sampled_like_all_segmentations(small, text):
    every = _all(text, small)
    n = 4000
    found = pieces.sample([text] * n, _seeds(n), small, 3)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    for ids, log_p in every.items():
        p = np.exp(log_p)
        assert abs(first[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    for f in found[:300]:
        assert all(abs(every[tuple(ids.tolist())] - log_p) < 1e-9 for ids, log_p, _, _ in f)
        assert len({tuple(one[0].tolist()) for one in f}) == len(f) == min(3, len(every))
        keys = [one[2] for one in f]
        assert keys == sorted(keys, reverse=True)
    # Scores by inclusion: an unbiased sum over all segmentations.
    value = lambda ids: len(ids)
    exact = sum(np.exp(w) * value(ids) for ids, w in every.items())
    guess = [sum(np.exp(w - q) * value(ids) for ids, w, _, q in f) for f in found]
    assert abs(np.mean(guess) - exact) < 5 * np.std(guess) / n**0.5 + 1e-9


def test_second_sample_is_without_replacement(small):
    """The pair's probability is p1 * p2 / (1 - p1)."""
    every, n = _all("ab", small), 6000
    found = Counter(tuple(tuple(one[0].tolist()) for one in f) for f in pieces.sample(["ab"] * n, _seeds(n), small, 2))
    for a, b in itertools.permutations(every, 2):
        p = np.exp(every[a]) * np.exp(every[b]) / (1 - np.exp(every[a]))
        assert abs(found[a, b] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_all_segmentations_come_out(small):
    every = _all("ab", small)
    found = pieces.sample(["ab"] * 20, _seeds(20), small, 50)
    for f in found:
        assert {tuple(one[0].tolist()) for one in f} == set(every) and all(one[3] == 0 for one in f)


def test_same_in_any_batch(real):
    texts = [prose(i, 40) for i in range(12)] + ["", "a", " "]
    together = pieces.sample(texts, _seeds(15), real, 3)
    for i, text in enumerate(texts):
        alone = pieces.sample([text], _seeds(15)[i : i + 1], real, 3)[0]
        assert [one[0].tolist() for one in alone] == [one[0].tolist() for one in together[i]]
        assert np.allclose([one[1:] for one in alone], [one[1:] for one in together[i]])


def test_round_trip_of_messy_rows(messy, nothing, real):
    rows = pieces.encode(messy, real, 3)
    got = pieces.decode(rows, real).collect()
    texts = Counter((r[0], r[1] or "") for r in messy_rows())
    firsts = Counter((r.key, r.decoded) for r in got if r["sample"] == 1)
    assert firsts == texts
    assert {(r.key, r.decoded) for r in got} == set(texts)
    assert all(r.n_pieces == len(r.ids) and r.log_inclusion <= 0 for r in got)
    assert pieces.encode(nothing, real).count() == 0


def test_decoded_like_a_plain_loop(real):
    bytes_ = {int(i): bytes([b]) for b, i in enumerate(real.byte_ids)}
    rnd = np.random.default_rng(4)
    known = [i for i in range(len(real.pieces)) if i not in bytes_]
    rows = [[int(i) for i in rnd.choice(known, rnd.integers(1, 30))] for _ in range(200)]
    rows += [[], None, [known[0], *real.byte_ids[list("漢é".encode())].tolist()]]

    def plain(ids):
        data = b"".join(bytes_.get(i) or real.pieces[i].replace("▁", " ").encode() for i in ids)
        return data[1:].decode()

    # Every text starts with the blank that encoding puts first.
    space = int(real.byte_ids[ord(" ")])
    rows = [r if not r else [space, *r] for r in rows]
    spelled = pieces._spelled(real)
    for at in (0, 7):
        got = pieces.decoded(pa.array(rows, pa.list_(pa.int32()))[at:], spelled).to_pylist()
        assert got == [None if r is None else plain(r) for r in rows[at:]]


def test_round_trip_gives_every_text_back(messy, nothing, real):
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = pieces.round_trip(messy, real, 3).collect()
    assert all(r.exact for r in got)
    assert Counter((r.key, r.decoded_sha256) for r in got if r["sample"] == 1) == Counter(
        (r[0], digest(r[1])) for r in messy_rows()
    )
    fields = ("key", "sample", "ids", "log_prob", "gumbel", "log_inclusion")
    plain = pieces.encode(messy, real, 3).collect()
    pick = lambda rows: sorted(([r[f] for f in fields] for r in rows), key=repr)
    assert pick(got) == pick(plain)
    assert pieces.round_trip(nothing, real).count() == 0


def test_a_segmentation_of_another_text_is_seen(monkeypatch, messy, real):
    whole = pieces.decoded
    monkeypatch.setattr(pieces, "decoded", lambda ids, spelled: pc.utf8_upper(whole(ids, spelled)))
    text = pa.record_batch({"key": [1, 2], "seed": pa.array([1, 2], pa.int64()), "text": ["ab", "AB"]})
    out = list(pieces._round_trip(iter([text]), real, 2))
    assert [e for b in out for e in b.column("exact").to_pylist()] == [False, False, True, True]


def test_one_long_word(real, spark):
    text = "x" * 3000 + "漢" * 500
    got = pieces.decode(pieces.encode(spark.createDataFrame([(1, text, None, None, 0)], SCHEMA), real), real).collect()
    assert [r.decoded for r in got] == [text, text] and got[0].ids != got[1].ids
