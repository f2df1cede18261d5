import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from .samples import SCHEMA, messy_rows
from textwarden.llm import exact

def _half():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


def _digests(n):
    return [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 100, 5000):
        keys = _digests(n)
        levels = exact.perfect_hash(keys)
        assert sorted(exact.slots_of(keys, levels)) == list(range(n))
        assert [list(x) for x in exact._unpacked(exact._packed(levels))] == [list(x) for x in levels]
    others = exact.slots_of([hashlib.sha256(f"x{i}".encode()).hexdigest() for i in range(500)], levels)
    assert others.min() >= -1 and others.max() < 5000


def _groups(rows):
    groups = defaultdict(list)
    for row in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or "")
        groups[hashlib.sha256(text.encode()).hexdigest()].append(row[0])
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        out += [(i, first, len(ids), i == first, digest) for i in ids]
    return sorted(out, key=repr)


def test_messy_rows_for_any_split(messy):
    for split in (_half(), F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        assert sorted(map(tuple, exact.exact_dedup(messy, split).collect()), key=repr) == _groups(messy_rows())


def test_many_parts(spark):
    rows = [(i, f"text {i % 700}", "en", "s", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = docs.select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"))
    groups = exact.exact_groups(keyed.filter("key < 900"), keyed.filter("key >= 900"), part_keys=64)
    got = {r.digest: (r.winner, r.copies, r.member) for r in groups.collect()}
    assert got == {hashlib.sha256(f"text {i}".encode()).hexdigest(): (i, 3 if i < 600 else 2, True) for i in range(700)}
    fresh = exact.exact_groups(keyed.filter("key < 10"), keyed.filter("key >= 10"), part_keys=64)
    assert fresh.filter("member").count() == 10 and fresh.count() == 700


def test_keep_first(messy):
    kept = exact.keep_first(messy, _half())
    assert kept.columns == messy.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts})
    assert len(texts) == len({g[4] for g in _groups(messy_rows())})


def test_nothing(nothing):
    assert exact.exact_dedup(nothing, _half()).count() == 0
    assert exact.keep_first(nothing, _half()).count() == 0
