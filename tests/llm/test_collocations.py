import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textwarden.llm import collocations

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
_BIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pieces(text):
    text = (text or "").translate(str.maketrans(_BIG, _BIG.lower()))
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def _counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in _pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def _expected(rows, least, top):
    f, n = _counts(rows)
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        best = Counter()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    best[p[i : i + k]] = max(best[p[i : i + k]], a)
        found = []
        for p, a in chosen.items():
            if 100 * best[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _corpus(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "Ab", "ab", "né", "NÉ", "x y", "nul\x00l", "漢字", "new", "york", "city", "z" * 300]
    stock = ["new york city hall", "of the", "the né of the", "ab ab ab ab ab", "new york"]
    out = []
    for i in range(n):
        text = "".join(
            (r.choice(stock) if r.random() < 0.4 else r.choice(words)) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b ", ""])
            for _ in range(r.randint(0, 60))
        )
        out.append((i, text, r.choice(["en", "en", "fr", None, "und"]), None, None))
    out += [(0, out[0][1], "en", None, None), (None, None, "en", None, None), (n, "", None, None, None), (n, " . ", "de", None, None)]
    return out + [(n + 1, "very common pair " * 3000, "de", None, None), (n + 2, "pair x. " * 50, "de", None, None)]


@pytest.mark.parametrize("least, top, parts", [(2, 2000, 1), (5, 7, 5), (30, 2000, 3)])
def test_against_brute_force(spark, monkeypatch, least, top, parts):
    rows = _corpus(least, 120)
    monkeypatch.setattr(collocations, "PART_BYTES", 1 + sum(len((t or "").encode()) for _, t, *_ in rows) // parts)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("?").alias(c) for c in ("part", "blob", "f", "phrase", "a", "words", "k")))
    expected = _expected([(t, lang) for _, t, lang, *_ in rows], least, top)
    assert len(expected) > 3
    for p in (1, 6):
        got = collocations.collocations(df.repartition(p), least, top).collect()
        assert sorted(map(tuple, got)) == expected


def test_blocks_and_flushes_do_not_matter(spark, monkeypatch):
    rows = _corpus(9, 150)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    f, n = _counts([(t, lang) for _, t, lang, *_ in rows])
    expected = sorted((lang, " ".join(p), len(p), c) for lang, own in f.items() for p, c in own.items() if c >= 4)
    batches = df.select("text", "lang").toArrow().to_batches(max_chunksize=7)
    for block, held in ((1 << 22, 3_000_000), (600, 500), (1, 1)):
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
        dealt = list(collocations._deal(iter(batches), 4))
        got, total = [], Counter()
        for part in range(4):
            for b in collocations._count((x for x in dealt if x.column("part")[0].as_py() == part), 4):
                for r in b.to_pylist():
                    if r["size"]:
                        got.append((r["lang"], r["phrase"], r["size"], r["f"]))
                    else:
                        total[r["lang"]] += r["f"]
        assert sorted(got) == expected and total == +n


def test_quicksort_against_a_counter():
    r = random.Random(3)
    rows = [[r.randint(0, 4), *(r.choice([0, 1, 1, 2, 7, 9]) for _ in range(2)), r.choice([-1, 3, 5, 5])] for _ in range(4000)]
    weight = np.array([r.randint(1, 5) for _ in rows])
    counts = Counter()
    for row, w in zip(rows, weight):
        for d in (2, 3):
            if row[d] >= 0:
                counts[tuple(row[: d + 1])] += int(w)
    for least in (1, 30, 200):
        got = {}
        for _, found, often in collocations.frequent(np.array(rows), weight, (2, 3), least):
            for row, o in zip(found.tolist(), often.tolist()):
                assert tuple(row) not in got
                got[tuple(row)] = o
        assert got == {k: v for k, v in counts.items() if v >= least}
    assert list(collocations.frequent(np.zeros((0, 4), int), np.zeros(0, int), (2, 3), 1)) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    huge = 2**61
    counted = spark.createDataFrame(
        [("en", "", 0, huge), ("en", "a", 1, huge + 5), ("en", "b", 1, huge + 2), ("en", "a b", 2, huge)], "lang string, phrase string, size int, f long"
    )
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counted)
    row = collocations.collocations(spark.createDataFrame([], SCHEMA)).first()
    assert (row["score"], row["a"], row["n"]) == (2_000_000 * huge // (2 * huge + 7), huge, huge)


def test_messy(spark, messy, nothing):
    assert collocations.collocations(nothing).count() == 0
    rows = [(r["text"], r["lang"]) for r in messy.select("text", "lang").collect()]
    got = collocations.collocations(messy).collect()
    assert sorted(map(tuple, got)) == _expected(rows, 30, 2000)


def _part(rows):
    """Suffixes of the rows as one part, in many packs."""
    text, lang = (pa.array(c, pa.string()) for c in zip(*rows))
    batches = pa.Table.from_arrays([text, lang], ["text", "lang"]).to_batches(max_chunksize=20)
    return [pa.Table.from_batches(list(collocations._deal(iter(batches), 1))).combine_chunks().to_batches()[0]]


def _counted(part, least):
    return [tuple(r.values()) for b in collocations._count(iter(part), least) for r in b.to_pylist()]


@pytest.mark.parametrize("few", [0, 300, 1 << 30])
def test_a_large_part_is_sorted_in_passes(monkeypatch, few):
    for name, value in (("HELD", 500), ("BLOCK_BYTES", 600), ("SORTED", 700), ("FEW", few), ("HASHED_BYTES", 9)):
        monkeypatch.setattr(collocations, name, value, raising=False)
    rows = [(t, lang) for _, t, lang, *_ in _corpus(4, 300)]
    part = _part(rows)
    sizes, sort = [], collocations.frequent
    monkeypatch.setattr(collocations, "frequent", lambda r, *a: sizes.append(len(r)) or sort(r, *a))
    f, n = _counts(rows)
    expected = [(lang, " ".join(p), len(p), c) for lang, own in f.items() for p, c in own.items() if c >= 3]
    assert sorted(_counted(part, 3)) == sorted(expected + [(lang, "", 0, c) for lang, c in (+n).items()])
    assert sum(sizes) > 5000 and max(sizes) < 2 * 700


def test_memory_of_a_part_does_not_follow_its_suffixes(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 60_000)
    monkeypatch.setattr(collocations, "SORTED", 20_000, raising=False)
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    part = _part([(" ".join(r.choices(words, k=200)), "en") for _ in range(1000)])
    tracemalloc.start()
    found = _counted(part, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 2000
    assert peak < 40 * 400_000  # a pair and a longer suffix a word


def test_words_are_hashed_in_stretches(monkeypatch):
    words = pa.array([b"a", b"bc", b"z" * 50, b"\x00", b"bc", b"d"], pa.large_binary())
    whole = collocations._word_hashes(words)
    for size in (1, 3, 60):
        monkeypatch.setattr(collocations, "HASHED_BYTES", size)
        assert (collocations._word_hashes(words) == whole).all()
    assert whole[1] == whole[4] and len(set(whole.tolist())) == 5
