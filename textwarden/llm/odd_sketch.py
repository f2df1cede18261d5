"""Near duplicates: MinHash bands, odd sketches, full sets.

A document is the set of its word shingles.  Documents with equal sets are one node.  The
MinHash samples of a node give it a bucket per band, and are folded into an odd sketch: a
bitmap in which every sample flips one bit.  Two sketches differ in as many bits as the
samples differ, so the population count of their exclusive or tells high similarities
apart; pairs whose count lies beyond six deviations of a link's are dropped.  The same
sketch over the whole set never differs in more bits than the sets differ in elements,
which drops more.  All others are confirmed on their full sets.

Buckets of few nodes give all their pairs.  A larger bucket gives a star: every node with
one of them, another one in every bucket, so the members of a large group meet many
centres and one chain of links holds them together.  What the stars leave apart in a
bucket is then compared with everything else there, in blocks, by sketch alone; only pairs
that may be links come out.  Nothing is capped, and the members of a group that is held
together are never paired among each other.

At the least similarity a pair shares no band with odds below 1e-7 (32 bands of 4 samples
at 0.8; below 1e-10 at 0.85).

Defined results: texts without words, null ones too, have an empty set and are linked with
nothing; rows with one id and one text share their answer; a row without an id never names
a component that has a row with one; empty tables give empty tables.  Memory in a task
grows with the longest text, never with a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import textnum
from textwarden.llm.components import components
from textwarden.llm.tables import written


class Settings(NamedTuple):
    """Words of a shingle, least similarity as a ratio of whole numbers, and the bands."""

    words: int = 5
    least: int = 80
    of: int = 100
    bands: int = 32
    rows: int = 4
    #: Bits of the odd sketch, a multiple of 64.
    bits: int = 512
    #: Buckets up to this size give all their pairs.
    small: int = 8

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing bits of two sketches beyond which a link is out of question."""
        k, j = self.samples, self.least / self.of
        return int(2 * (k - (k * j - 6 * (k * j * (1 - j)) ** 0.5))) + 1


_SCHEMA = (
    "key {kind}, hash long, n long, node binary, bands array<long>, sketch array<long>, parity array<long>, blob binary"
)
#: Nodes to a block, when the parts of a bucket are compared.
BLOCK = 512


def shingle_sets(rows: list[str], words: int) -> list[np.ndarray]:
    """Each row's distinct shingles, as sorted hashes."""
    code, starts = textnum.codes(rows)
    code = np.where((code >= 65) & (code <= 90), code + 32, code)
    begin, end = textnum.runs(~((code == 32) | ((code >= 9) & (code <= 13))))
    word = textnum.range_hash(textnum.prefix_hash(code), begin, end)
    first = np.searchsorted(begin, starts)
    rolled = np.zeros(len(word), np.uint64)
    for k in range(words):
        rolled[: max(0, len(word) - k)] += textnum.mixed(word[k:] + np.uint64(k + 1))
    rolled = textnum.mixed(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = sum(int(textnum.mixed(word[a + k : a + k + 1] + np.uint64(k + 1))[0]) for k in range(b - a)) + int(b - a)
            out.append(textnum.mixed(np.array([whole % 2**64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], settings: Settings) -> np.ndarray:
    """MinHash samples of sets, none of them empty: sets x samples."""
    random = np.random.default_rng(4)
    factor = random.integers(0, 2**63, settings.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(0, 2**63, settings.samples, dtype=np.uint64)
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), settings.samples), np.uint64)
    for k in range(settings.samples):
        out[:, k] = np.minimum.reduceat(flat * factor[k] + shift[k], start)
    return out


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps as 64-bit words: every sample flips the bit it hashes to."""
    place = textnum.mixed(samples + np.arange(samples.shape[1], dtype=np.uint64)) % np.uint64(bits)
    out = np.zeros((len(samples), bits // 64), np.uint64)
    for k in range(samples.shape[1]):
        word, bit = np.divmod(place[:, k], np.uint64(64))
        out[np.arange(len(samples)), word.astype(np.int64)] ^= np.uint64(1) << bit
    return out


def parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Odd sketches of whole sets: two of them differ in no more bits than their sets do in elements."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = textnum.mixed(np.concatenate(sets) + np.uint64(9)) % np.uint64(bits)
    word, bit = np.divmod(place, np.uint64(64))
    np.bitwise_xor.at(out, (row, word.astype(np.int64)), np.uint64(1) << bit)
    return out


def _band_hashes(samples: np.ndarray, settings: Settings) -> np.ndarray:
    parts = samples.reshape(len(samples), settings.bands, settings.rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for r in range(settings.rows):
        total = textnum.mixed(total + parts[:, :, r])
    return textnum.mixed(total + np.arange(settings.bands, dtype=np.uint64))


def _lists(values: np.ndarray) -> pa.ListArray:
    flat = pa.array(values.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat)


def _describe(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in textnum.blocks(batches):
        rows = textnum.texts(batch)
        sets = shingle_sets(rows, settings.words)
        full = np.flatnonzero([len(s) for s in sets])
        bands = np.zeros((len(rows), settings.bands), np.uint64)
        sketch = np.zeros((len(rows), settings.bits // 64), np.uint64)
        parity = sketch.copy()
        if len(full):
            samples = signatures([sets[i] for i in full], settings)
            bands[full], sketch[full] = _band_hashes(samples, settings), odd_sketches(samples, settings.bits)
            parity[full] = parities([sets[i] for i in full], settings.bits)
        sums = [(int(s.sum()), int(textnum.mixed(s + np.uint64(1)).sum())) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in sums], pa.binary()),
                _lists(bands), _lists(sketch), _lists(parity),
                pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in rows], pa.binary()),
            ],
            ["key", "hash", "n", "node", "bands", "sketch", "parity", "blob"],
        )


def describe(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's set size, node, bands, sketch, and its packed text for the last check."""
    rows = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _describe(it, settings), _SCHEMA.format(kind=kind))


def _order() -> Column:
    """Sorts rows by id, those without one last, then by text."""
    return F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("hash").alias("hash"))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, node, size, center)`` of buckets with two nodes or more."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    # Which node is the centre is drawn anew in every bucket.
    center = F.min_by("node", F.xxhash64("node", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), center.alias("center")).filter("size > 1")
    return rows.join(sizes, "bucket")


def _first_pairs(buckets: DataFrame, settings: Settings) -> DataFrame:
    few = buckets.filter(F.col("size") <= settings.small).groupBy("bucket").agg(F.collect_list("node").alias("all"))
    firsts = few.select("all", F.explode("all").alias("a"))
    pairs = firsts.select("a", F.explode("all").alias("b")).filter("a < b")
    stars = buckets.filter((F.col("size") > settings.small) & (F.col("node") != F.col("center"))).select(
        F.col("center").alias("a"), F.col("node").alias("b")
    )
    return _ordered_pairs(pairs.union(stars))


def likely(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose odd sketches and parities do not rule a link out."""
    sides = [nodes.select(F.col("node").alias(s), F.struct("n", "sketch", "parity").alias(f"_{s}")) for s in "ab"]
    bits = lambda c: F.aggregate(
        F.zip_with(F.col("_a")[c], F.col("_b")[c], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    room = (settings.of + settings.least) * bits("parity") <= (settings.of - settings.least) * (F.col("_a.n") + F.col("_b.n"))
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.filter((bits("sketch") <= settings.most_bits) & room).select("a", "b")


def _measure(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pairs = list(zip(part.column("blob_a").to_pylist(), part.column("blob_b").to_pylist()))
            blobs = list(dict.fromkeys(blob for pair in pairs for blob in pair))
            texts = [unpack.decompress(blob).decode("utf-8", "surrogatepass") for blob in blobs]
            sets = dict(zip(blobs, shingle_sets(texts, words)))
            shared = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs]
            united = [len(sets[a]) + len(sets[b]) - n for (a, b), n in zip(pairs, shared)]
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(shared, pa.int64()), pa.array(united, pa.int64())],
                ["a", "b", "shared", "united"],
            )


def measured(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """``(a, b, shared, united)``: the sizes that the pairs' full sets have in common and together.

    Only the texts of nodes in pairs travel: each node's first row is found by node and
    id, so rows of a large group of copies are dealt out evenly.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = nodes.join(needed, "node").select(
        F.col("node").alias("_node"), F.col("first.key").alias("_key"), F.col("first.hash").alias("_hash")
    )
    texts = rows.join(
        first, (F.col("node") == F.col("_node")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash"))
    ).dropDuplicates(["_node", "_key", "_hash"]).select("node", "blob")
    sides = [texts.select(F.col("node").alias(s), F.col("blob").alias(f"blob_{s}")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(
        lambda it: _measure(it, settings.words), "a binary, b binary, shared long, united long"
    )


def _linked(settings: Settings) -> Column:
    return settings.of * F.col("shared") >= settings.least * F.col("united")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of ``x`` with all rows of ``y``."""
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _tile(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks of a bucket that may be links and belong to different components.

    A pair comes out of the first bucket it shares, only.
    """
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values for c in ("xs", "ys"))
            (nx, lx, sx, px, bx), (ny, ly, sy, py, by) = (
                (
                    side.field("n").to_numpy(), side.field("part").to_numpy(),
                    *(np.stack(side.field(c).to_numpy(zero_copy_only=False)).view(np.uint64) for c in ("sketch", "parity", "bands")),
                )
                for side in (x, y)
            )
            room = (settings.of - settings.least) * (nx[:, None] + ny[None, :])
            near = (lx[:, None] != ly[None, :]) & ((settings.of + settings.least) * _differing(px, py) <= room)
            near &= _differing(sx, sy) <= settings.most_bits
            a, b = np.nonzero(near)
            shared = bx[a] == by[b]
            at = np.arange(len(a))
            first = bx[a][at, shared.argmax(axis=1)] == np.uint64(batch.column("bucket")[i].as_py() % 2**64)
            a, b = a[first], b[first]
            left, right = x.field("node").to_pylist(), y.field("node").to_pylist()
            found += [(left[j], right[k]) for j, k in zip(a, b)]
        rows = list(zip(*set(found))) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], ["a", "b"])


def _left_apart(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that share a large bucket but neither a component nor a test, and may be links.

    In every bucket the members outside its largest component are compared with all
    members of other components, block by block; only what the sketches leave open comes out.
    """
    large = buckets.filter(F.col("size") > settings.small).select("bucket", "node")
    named = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts")
    )
    split = written(named.join(main.filter("parts > 1").select("bucket", "main", "size"), "bucket"))
    member = F.struct("node", "n", F.xxhash64("label").alias("part"), "sketch", "parity", "bands")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("block")
    full = split.join(nodes.select("node", "n", "sketch", "parity", "bands"), "node").select(
        "bucket", block, (F.col("label") != F.col("main")).alias("aside"), member.alias("member")
    )
    full = written(full)
    xs = full.filter("aside").groupBy("bucket", "block").agg(F.collect_list("member").alias("xs")).drop("block")
    ys = full.groupBy("bucket", "block").agg(F.collect_list("member").alias("ys")).drop("block")
    near = xs.join(ys, "bucket").select("bucket", "xs", "ys").mapInArrow(lambda it: _tile(it, settings), "a binary, b binary")
    return _ordered_pairs(near).join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _classes(rows: DataFrame, settings: Settings) -> DataFrame:
    """``(node, rep)``: the first row of the component a node belongs to."""
    nodes = written(rows.filter("n > 0").groupBy("node").agg(
        F.min(_order()).alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch", "parity"))
    ))
    buckets = written(_buckets(nodes))
    tested = written(measured(written(likely(_first_pairs(buckets, settings), nodes, settings)), rows, nodes, settings))
    links = tested.filter(_linked(settings)).select("a", "b")
    labels = components(links)
    more = written(_left_apart(buckets, nodes, labels, tested, settings))
    if not more.isEmpty():
        further = written(measured(more, rows, nodes, settings).filter(_linked(settings)).select("a", "b"))
        if not further.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(further))
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    reps = named.groupBy("label").agg(F.min("first").alias("rep"))
    return named.select("node", "label").join(reps, "label").select("node", "rep")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, hash, n_shingles, component_id, kept, first)``, one row per document.

    ``kept``: the row's id names its component; ``first``: of rows that share this id, the
    one that stands for the component.
    """
    rows = written(describe(docs, settings, key, text))
    narrow = rows.select("key", "hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    full = narrow.filter("n > 0").join(_classes(rows, settings), "node").select("key", "hash", "n", "rep")
    empty = narrow.filter("n = 0").select("key", "hash", "n", _order().alias("rep"))
    return full.unionByName(empty).select(
        F.col("key").alias(key), "hash", F.col("n").alias("n_shingles"), F.col("rep.key").alias("component_id"),
        F.col("key").eqNullSafe(F.col("rep.key")).alias("kept"),
        (F.col("key").eqNullSafe(F.col("rep.key")) & (F.col("hash") == F.col("rep.hash"))).alias("first"),
    )


def keep_one(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component, with all their columns."""
    stays = near_duplicates(docs, settings, key, text).filter("first").select(
        F.col(key).alias("_key"), F.col("hash").alias("_of")
    ).distinct()
    # The row travels as one column: its own names may be anything.
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    joined = named.join(stays, F.col("_row")[key].eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_of")))
    return joined.dropDuplicates(["_key", "_of"]).select("_row.*")
