"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on up to one
name for the whole.  Where a phrase ends depends only on a few symbols around, never on the
place in the text: runs of one symbol become one symbol, deterministic coin tossing turns
neighbouring symbols into labels below six that still differ from neighbour to neighbour,
and phrases begin at the labels that are greater than both neighbours.  A phrase is named by
its content alone, so equal substrings share the names of all phrases in their interior, in
whatever document and at whatever offset.  Every level is at most half as long as the one
below, so all levels together cost about as much as the first.

The fingerprint is a sample of a text's set of names, in which a name counts with the number
of characters it stands for: names are dealt to bins by their bits, and each bin keeps the
one with the earliest arrival of an exponential clock whose rate is that length.  Two texts
agree in a bin with the odds of the common part, by length, of the names either has there.
The part of the bins in which two fingerprints agree is a number from 0 to 1 that estimates
the mean of those parts: how much of the two texts' phrases is common, with the few longest
phrases, whole texts among them, counting no more than the bins they fall into.

Every document is compared with an edited text, made of it and the document next in falling
order of ids.  Documents are dealt by ranges of the id, once; the pair at the border of two
ranges is completed afterwards from the two texts at the border.

Defined results: a null text is empty; an empty text has a fingerprint of empty bins, which
is like itself (1.0) and like no other (0.0).  Rows without an id come last in the order.
Rows that share an id are ordered by their text's hash, and those that also share the text
are the same to everyone.  The last document's next is the first; an only document is its
own.  Long texts are parsed whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textwarden.llm import textnum
from textwarden.llm.tables import written

#: Bins of a fingerprint, and the bits a bin keeps of a name.
BINS = 64
TAG_BITS = 16
#: Characters parsed at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 18
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _first_names() -> np.ndarray:
    """A name for every code point."""
    return textnum.mixed(np.arange(0x110000, dtype=np.uint64) + _STEP)


@lru_cache
def _lowest_bit() -> np.ndarray:
    """The place of the lowest bit set in a byte; 8 for none."""
    return np.array([(x & -x).bit_length() - 1 if x else 8 for x in range(256)], np.uint8)


@lru_cache
def _toss(size: int) -> np.ndarray:
    """Coin tossing for two labels below ``size``: twice the lowest place they differ in, plus the own bit there.

    The row is the own label, the column its left neighbour's.
    """
    out = np.zeros((size, size), np.uint8)
    for own in range(size):
        for left in range(size):
            differ = own ^ left
            if differ:
                place = (differ & -differ).bit_length() - 1
                out[own, left] = 2 * place + (own >> place & 1)
    return out.ravel()


def labels(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below six, unlike their neighbours'; ``head`` marks where texts begin.

    Names next to each other in a text differ.  Four rounds: 64 bits to 128 labels, to 14,
    to 8, to 6.  The first symbol of a text has no left neighbour and takes its lowest bit.
    """
    n = len(names)
    low = names.view(np.uint8)[::8] if names.dtype.byteorder in "=<" else (names & np.uint64(255)).astype(np.uint8)
    low = np.ascontiguousarray(low)
    differ = np.zeros(n, np.uint8)
    differ[1:] = low[1:] ^ low[:-1]
    place = _lowest_bit()[differ]
    label = 2 * (place & 7) + (low >> (place & 7) & 1)
    far = np.flatnonzero((differ == 0) & ~head)
    if len(far):
        own, left = names[far], names[far - 1]
        both = own ^ left
        bit = both & (~both + np.uint64(1))
        at = np.log2(np.maximum(bit, np.uint64(1)).astype(np.float64)).astype(np.uint8)
        label[far] = 2 * at + ((own & bit) != 0)
    label[head] = low[head] & 1
    for size in (128, 14, 8):
        pair = label.astype(np.uint16)
        pair[1:] = pair[1:] * np.uint16(size) + label[:-1]
        pair[0] = 0
        after = _toss(size)[pair]
        after[head] = label[head] & 1
        label = after
    return label


def _collapse(names: np.ndarray, doc: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol within a text as one symbol, named by it and its number."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    if new.all():
        return names, doc, length
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(names)))
    out = names[begin]
    several = np.flatnonzero(size > 1)
    out[several] = textnum.mixed(out[several] * _SPREAD + size[several].astype(np.uint64))
    return out, doc[begin], length[begin] * size


def phrases(rows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, name, length)`` of all phrases of some texts, level by level from the smallest on.

    Levels end for a text with the phrase that is the whole of it.
    """
    counts = np.array([len(t) for t in rows], np.int64)
    flat = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(flat):
        return
    names = _first_names()[flat]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    length = np.ones(len(flat), np.int64)
    while len(names):
        names, doc, length = _collapse(names, doc, length)
        head = np.ones(len(names), bool)
        head[1:] = doc[1:] != doc[:-1]
        label = labels(names, head)
        # A phrase begins with a text, and where a label is greater than both its neighbours,
        # but neither right after that beginning nor at the end: no phrase of a longer text
        # is a single symbol.
        begin = np.zeros(len(names), bool)
        begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        begin[1:] &= ~head[:-1]
        begin[:-1] &= ~head[1:]
        begin |= head
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, len(names)))
        name = names[start]
        longer, k = np.arange(len(start)), 1
        while len(longer := longer[size[longer] > k]):
            name[longer] = name[longer] * _SPREAD + names[start[longer] + k]
            k += 1
        name = textnum.mixed(name + size.astype(np.uint64) * _STEP)
        names, doc, length = name, doc[start], np.add.reduceat(length, start)
        yield doc, names, length
        # A text that is one phrase by now is done.
        single = np.ones(len(doc) + 1, bool)
        single[1:-1] = doc[1:] != doc[:-1]
        several = ~(single[1:] & single[:-1])
        names, doc, length = names[several], doc[several], length[several]


def sketches(rows: list[str]) -> np.ndarray:
    """A line of ``BINS`` cells for every text: the tag of a name plus one, or zero for an empty bin."""
    cells = len(rows) * BINS
    cell, name, arrival = [], [], []
    first = np.full(cells, np.inf)
    for doc, names, length in phrases(rows):
        own = doc.astype(np.int64) * BINS + (names & np.uint64(BINS - 1)).astype(np.int64)
        u = ((names >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = -np.log(u) / length
        np.minimum.at(first, own, at)
        # What is not first by now never will be.
        early = at <= first[own]
        cell.append(own[early])
        name.append(names[early])
        arrival.append(at[early])
    out = np.zeros(cells, np.uint32)
    if cell:
        own, names, at = (np.concatenate(c) for c in (cell, name, arrival))
        kept = at == first[own]
        # The clock reads the upper bits and the bin the lowest: the tag comes from a fresh mix.
        tag = textnum.mixed(names[kept] + _STEP) >> np.uint64(64 - TAG_BITS)
        out[own[kept]] = tag.astype(np.uint32) + 1
    return out.reshape(len(rows), BINS)


def fingerprints(rows: list[str]) -> np.ndarray:
    """``sketches``, block by block; the same for a text whatever its neighbours."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(rows):
        if held and held + len(t) > BLOCK_CHARS:
            out.append(sketches(rows[begin:i]))
            begin, held = i, 0
        held += len(t)
    out.append(sketches(rows[begin:]))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of the bins used by either line in which both agree; 1 for two lines without any."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def as_text(sketch: np.ndarray) -> list[str]:
    """Lines as text: four hexadecimal digits a bin, and four dots for an empty one."""
    digits = TAG_BITS // 4
    return ["".join(f"{tag - 1:0{digits}x}" if tag else "." * digits for tag in line) for line in sketch.tolist()]


def edited(text: str, after: str) -> str:
    """The text whose last third gave way to as many characters of another one, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


_KINDS = {
    "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double",
}
_RESULT = ", ".join(f"{name} {kind}" for name, kind in _KINDS.items())


def _compared(texts: list[str], own: np.ndarray, after: list[str], following: np.ndarray) -> list[pa.Array]:
    """The result columns of documents with the text and the sketch of the next one."""
    changed = [edited(t, a) for t, a in zip(texts, after)]
    edit = fingerprints(changed)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(as_text(own), pa.string()),
        pa.array(as_text(edit), pa.string()),
        pa.array(likeness(own, edit), pa.float64()),
        pa.array(likeness(own, following), pa.float64()),
    ]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a range of documents in order; its first and last text travel on, for the ranges beside it."""
    part = TaskContext.get().partitionId()
    names = ["key", *_KINDS, "part", "edge", "text"]
    kind = None

    def finished(keys, texts, own, after, following, first):
        columns = _compared(texts, own, after, following)
        edge = ["first" if first and i == 0 else None for i in range(len(keys))]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), *columns, pa.array([part] * len(keys), pa.int64()), pa.array(edge, pa.string()),
             pa.array([t if e else None for t, e in zip(texts, edge)], pa.string())], names,
        )

    carried, first = None, True  # the document that waits for the next one: its key, text and sketch
    for batch in batches:
        kind = batch.schema.field("key").type
        for block in textnum.blocks([batch], limit=BLOCK_CHARS):
            keys, texts = block.column("key").to_pylist(), textnum.texts(block)
            sketch = fingerprints(texts)
            if carried:
                keys, texts = [carried[0], *keys], [carried[1], *texts]
                sketch = np.concatenate([carried[2], sketch])
            carried = keys[-1], texts[-1], sketch[-1:]
            if len(keys) > 1:
                yield finished(keys[:-1], texts[:-1], sketch[:-1], texts[1:], sketch[1:], first)
                first = False
    if carried:
        # The last one has no results yet.
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([carried[0]], kind), *nothing, pa.array([part], pa.int64()),
             pa.array(["only" if first else "last"], pa.string()), pa.array([carried[1]], pa.string())], names,
        )


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents whose next one starts another range."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            texts, after = textnum.texts(row), textnum.texts(row, "after")
            columns = _compared(texts, fingerprints(texts), after, fingerprints(after))
            yield pa.RecordBatch.from_arrays([row.column("key"), *columns], ["key", *_KINDS])


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every document."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = [F.col("key").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))]
    kind = rows.schema["key"].dataType.simpleString()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_in_order, f"key {kind}, {_RESULT}, part long, edge string, text string"))
    done = found.filter(F.col("n_chars").isNotNull()).select("key", *_KINDS)
    # One row a range: its number, the next one's, and after the last the first.
    begins = found.filter(F.col("edge").isin("first", "only")).select("part")
    order = Window.orderBy("part")
    following = begins.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    last = found.filter(F.col("edge").isin("last", "only")).select("key", "part", "text")
    after = found.filter(F.col("edge").isin("first", "only")).select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    borders = last.join(following, "part").join(after, "next_part").select("key", "text", "after")
    return done.union(borders.mapInArrow(_at_borders, f"key {kind}, {_RESULT}")).withColumnRenamed("key", key)
