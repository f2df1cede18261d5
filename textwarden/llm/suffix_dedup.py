"""Repeated passages, removed byte by byte: sampled suffixes in deep-shallow order.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a
document with a smaller id, or at a smaller place of the same document.  Every string of
that length is found again by its anchor, the run of ``GRAM`` bytes with the smallest
hash in it; equal strings have equal anchors at equal offsets.  Neighbouring strings with
one anchor travel together, as one passage, and in two halves by offset, so that all
strings of a half hold the same ``CORE`` bytes or more around the anchor.

1. Tasks find the passages of their rows.  Of passages that agree among many rows at once
   the first goes on; the others are repeats already.  Cores go to parts by their hash.
2. A part finds the cores that occur more than once.
3. Documents meet their repeated cores and send those passages' bytes to parts.
4. A part sorts the passages of a core twice, rightwards and leftwards from the anchor:
   multikey quicksort on words of eight bytes to a shallow depth, then blind tries for the
   groups that agree so far.  Two strings at one offset are equal if their passages have
   long enough common prefixes on both sides; the first in document order stays.
5. Documents meet the ranges that go, and drop them.

What is shuffled is packed by part; the number of parts follows the bytes of the input.
Copies of a hot text are one passage per place and some hundred thousand passages.  Passages that
share a core but differ around it, as at the edges of a passage that very many documents
quote, are sorted in one part, about 150 bytes each.

Defined results: null text is empty; nothing is removed from texts shorter than
``LENGTH`` bytes; rows without an id come after all others and count as one document id;
rows that share an id are no repeats of each other, and only their own starts count as
theirs, told apart by 64 bits of their texts' hashes; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm import textnum

LENGTH, GRAM = 100, 32
#: Offsets of an anchor in a string, and the first of the second half.
OFFSETS = LENGTH - GRAM + 1
HALF = (OFFSETS + 1) // 2
CORE = LENGTH - HALF + 1
#: Bytes of text to a part, and bytes of a text hashed at once.
PART_BYTES, SEGMENT = 8 << 20, 8 << 20
#: Bytes of text whose passages are found at once.
BLOCK_BYTES = 1 << 20
#: Passages that a task holds before it packs them.
HELD = 1 << 19
#: Depth in bytes at which quicksort gives way to blind tries.
SHALLOW = 32
_NO_ID = 2**63 - 1
_PLACE_BITS = np.uint64(24)
_BASE = 0x9E3779B97F4A7C15
#: What a passage is: its core's hash, its document, its anchor's place, its offsets.
_FIELDS = (("core", "<u8"), ("okey", "<i8"), ("row", "<i8"), ("at", "<i4"), ("low", "u1"), ("high", "u1"))
_SPANS = (("okey", "<i8"), ("row", "<i8"), ("start", "<i4"), ("end", "<i4"))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` bytes, by doubling."""
    h = textnum.mixed(np.arange(256, dtype=np.uint64) + np.uint64(_BASE))[data]
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Passages(NamedTuple):
    """Anchors in a stretch of bytes, the offsets of the strings they stand for, hashes of core and whole."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    whole: np.ndarray


def passages(data: np.ndarray, ends: np.ndarray) -> Passages:
    """The passages of a stretch of texts that end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Passages(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    gram = _grams(data)
    place = np.arange(len(gram), dtype=np.uint64)
    # The place breaks ties to the left, whatever the stretch.
    ranked = (textnum.mixed(gram) >> _PLACE_BITS << _PLACE_BITS) | place
    anchor = (_least(ranked, OFFSETS) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int8)
    long_ = ends - first >= LENGTH
    np.add.at(inside, first[long_], 1)
    np.add.at(inside, ends[long_] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    if not len(start):
        return Passages(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    a = anchor[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(a)) - 1
    at, low, high = a[begin], a[begin] - start[last], a[begin] - start[begin]
    near, far = low < HALF, high >= HALF
    at = np.concatenate([at[near], at[far]])
    low, high = np.concatenate([low[near], np.maximum(low[far], HALF)]), np.concatenate([np.minimum(high[near], HALF - 1), high[far]])
    second = low >= HALF
    left = np.where(second, at - HALF, at)
    right = np.where(second, at + GRAM, at + CORE)
    core = _covered(gram, left, right, second.astype(np.uint64))
    whole = _covered(gram, at - high, at - low + LENGTH, core + (low * 256 + high).astype(np.uint64))
    return Passages(at, low, high, core, whole)


def _covered(gram: np.ndarray, left: np.ndarray, right: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of ranges of ``CORE`` to ``5 * GRAM`` bytes, from the runs that cover them."""
    out = textnum.mixed(seed + (right - left).astype(np.uint64))
    for k in range(5):
        out = textnum.mixed(out + gram[np.minimum(left + k * GRAM, right - GRAM)])
    return out


def _packed(columns: dict[str, np.ndarray], extra: bytes = b"") -> bytes:
    head = np.array([len(next(iter(columns.values())))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns.values()) + extra)


def _unpacked(blobs: list[bytes], fields: tuple) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns of all blobs together, and what follows them in each."""
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in fields}
    rest = []
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(data, "<i8", 1)[0]), 8
        for name, kind in fields:
            parts[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        rest.append(data[at:])
    return {name: np.concatenate(p) for name, p in parts.items()}, rest


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray], fields: tuple) -> Iterator[tuple[int, bytes]]:
    """A packed row for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        if b > a:
            own = order[a:b]
            yield int(part[a]), _packed({name: columns[name][own].astype(kind) for name, kind in fields})


def _document_part(okey: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    return (textnum.mixed(okey.astype(np.uint64) * np.uint64(3) + row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _core_part(core: np.ndarray, parts: int) -> np.ndarray:
    return (textnum.mixed(core) % np.uint64(parts)).astype(np.int64)


def _split(table: pa.Table, kind: str) -> tuple[list[bytes], list[tuple[str, int, bytes]]]:
    """The blobs of a kind, and the other rows as they are: known spans travel along."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "blob"))))
    return [r[2] for r in rows if r[0] == kind], [r for r in rows if r[0] != kind]


def _kind(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, part, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(part, pa.int64()), pa.array(blob, pa.binary())], ["kind", "part", "blob"]
    )


def _stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, ends, text, place in it)``: all texts at once, or one long text in overlapping cuts."""
    size = np.array([len(t) for t in texts], np.int64)
    if size.sum() <= 2 * SEGMENT:
        yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size), np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            cut = text[a : a + SEGMENT + LENGTH - 1]
            yield np.frombuffer(cut, np.uint8), np.array([len(cut)]), np.array([i]), np.array([a])


def _find(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    for batch in textnum.blocks(batches, limit=BLOCK_BYTES):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        okey, row = batch.column("okey").to_numpy(), batch.column("row").to_numpy()
        found: dict[str, list] = {name: [] for name in ("okey", "row", "at", "low", "high", "core", "whole")}
        for data, ends, text, offset in _stretches(texts):
            p = passages(data, ends)
            own = np.searchsorted(ends, p.at, side="right")
            begin = np.concatenate([[0], ends[:-1]])
            found["okey"].append(okey[text[own]])
            found["row"].append(row[text[own]])
            found["at"].append(p.at - begin[own] + offset[own])
            for name in ("low", "high", "core", "whole"):
                found[name].append(getattr(p, name))
        c = {name: np.concatenate(parts_) if parts_ else np.zeros(0, np.int64) for name, parts_ in found.items()}
        if not len(c["at"]):
            continue
        held.append(c)
        if sum(len(h["at"]) for h in held) >= HELD:
            yield _pack_found(held, parts)
            held = []
    if held:
        yield _pack_found(held, parts)


def _pack_found(held: list[dict[str, np.ndarray]], parts: int) -> pa.RecordBatch:
    """Passages by the part of their core; those that repeat one among them are spans already."""
    c = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
    order = np.lexsort((c["at"], c["row"], c["okey"], c["whole"]))
    c = {name: column[order] for name, column in c.items()}
    repeat = _repeats(c["whole"], c["okey"], c["row"], c["at"])
    span = {k: c[k][repeat] for k in ("okey", "row")}
    span["start"] = (c["at"] - c["high"])[repeat]
    span["end"] = (c["at"] - c["low"])[repeat] + LENGTH
    by_document = np.lexsort((c["at"], c["row"], c["okey"]))
    by_document = by_document[~repeat[by_document]]  # which packs better
    c = {name: column[by_document] for name, column in c.items()}
    rows = [("core", p, b) for p, b in _dealt(_core_part(c["core"], parts), c, _FIELDS)]
    rows += [("span", p, b) for p, b in _dealt(_document_part(span["okey"], span["row"], parts), span, _SPANS)]
    return _kind(rows)


def _repeats(group: np.ndarray, okey: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which occurrences have an earlier one in their group; sorted by group, id, row and place."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    same = np.zeros(n, bool)
    same[1:] = ~new[1:] & (okey[1:] == okey[:-1]) & (row[1:] == row[:-1])
    run = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return (okey > okey[first]) | (at > at[run])


def _repeated_cores(table: pa.Table, parts: int) -> pa.Table:
    """The passages of a part whose core occurs at two places, by the part of their document."""
    blobs, others = _split(table, "core")
    c, _ = _unpacked(blobs, _FIELDS)
    order = np.lexsort((c["at"], c["row"], c["okey"], c["core"]))
    c = {name: column[order] for name, column in c.items()}
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = c["core"][1:] == c["core"][:-1]
    again = same[1:] | same[:-1]
    again = again[by_document := np.lexsort((c["at"], c["row"], c["okey"]))]
    c = {name: column[by_document[again]] for name, column in c.items()}
    rows = others + [("core", p, b) for p, b in _dealt(_document_part(c["okey"], c["row"], parts), c, _FIELDS)]
    return pa.Table.from_batches([_kind(rows)])


class Sorted(NamedTuple):
    """Strings in order, and the bytes each has in common with the one before it in its group."""

    order: np.ndarray
    common: np.ndarray


def _words(flat: np.ndarray, start: np.ndarray, size: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The eight bytes of each string at a depth, as numbers that sort like them; zeros past its end."""
    at = start + depth
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        byte = np.where(depth + k < size, flat[np.minimum(at + k, len(flat) - 1)], 0)
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out


def deep_shallow(flat: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> Sorted:
    """Sorts the strings of every group, groups being numbered in ascending order.

    All segments of one depth are partitioned at once: less than, equal to, greater than
    the word of a pivot; the equal ones go one word deeper.  Segments that reach the
    shallow depth are ordered by blind tries.
    """
    n = len(start)
    order = np.arange(n)
    segment = group.astype(np.int64)
    depth = np.zeros(n, np.int64)
    deep: list[np.ndarray] = []
    active = np.arange(n)  # positions in ``order``
    while len(active):
        own = segment[active]
        new = np.ones(len(active), bool)
        new[1:] = own[1:] != own[:-1]
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(active)))
        several = np.repeat(length > 1, length)
        down = depth[active] >= shallow
        for a, m in zip(begin[(length > 1) & down[begin]], length[(length > 1) & down[begin]]):
            deep.append(active[a : a + m])
        keep = several & ~down
        active = active[keep]
        if not len(active):
            break
        kept = (length > 1) & ~down[begin]
        length = length[kept]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = order[active]
        word = _words(flat, start[at], size[at], depth[active])
        pivot = np.repeat(word[begin + length // 2], length)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        number = np.repeat(np.arange(len(length)), length) * 3 + side
        by = np.argsort(number, kind="stable")
        order[active] = at[by]
        depth[active] = np.where(side[by] == 1, depth[active][by] + 8, depth[active][by])
        segment[active] = number[by]
    for places in deep:
        order[places] = _blind_trie(flat, start, size, order[places], shallow)
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    far = int(size.max(initial=0))
    done = np.zeros(len(pair), np.int64)
    live = np.arange(len(pair))
    while len(live):
        i, j = order[pair[live]], order[pair[live] - 1]
        differ = _words(flat, start[i], size[i], done[live]) ^ _words(flat, start[j], size[j], done[live])
        equal = differ == 0
        for k in range(1, 8):
            done[live] += ~equal & (differ < np.uint64(1 << (8 * k)))
        done[live[equal]] += 8
        live = live[equal & (done[live] < far)]
    common[pair] = np.minimum(done, far)
    return Sorted(order, common)


def _blind_trie(flat: np.ndarray, start: np.ndarray, size: np.ndarray, members: np.ndarray, depth: int) -> list[int]:
    """The members in order.  They agree up to ``depth``.

    A node knows the depth at which its strings part and the byte each branch starts with.
    A string first follows bytes alone down to some leaf, is compared with that leaf's
    string once, and is then put where the two part.
    """
    width = int(size[members].max())
    text = {int(m): flat[start[m] : start[m] + size[m]].tobytes().ljust(width, b"\0") for m in members}
    root: list = [int(members[0])]  # a leaf: strings that agree in all bytes
    for m in members[1:].tolist():
        own, node = text[m], root
        while isinstance(node[0], tuple):
            at, branches = node[0]
            node = branches.get(own[at]) or next(iter(branches.values()))
        other = text[node[0]]
        parts = _parting(own, other, depth)
        if parts == width:
            node.append(m)
            continue
        node = root
        while isinstance(node[0], tuple) and node[0][0] < parts:
            node = node[0][1][own[node[0][0]]]
        if isinstance(node[0], tuple) and node[0][0] == parts:
            node[0][1][own[parts]] = [m]
        else:
            below = node[:]
            node[:] = [(parts, {other[parts]: below, own[parts]: [m]})]
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node[0], tuple):
            todo += [node[0][1][byte] for byte in sorted(node[0][1], reverse=True)]
        else:
            out += node
    return out


def _parting(a: bytes, b: bytes, depth: int) -> int:
    """The first place from ``depth`` on at which two strings of one length differ, or their length."""
    differ = int.from_bytes(a[depth:], "big") ^ int.from_bytes(b[depth:], "big")
    return len(a) - (differ.bit_length() + 7) // 8


def _compare(c: dict[str, np.ndarray], flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For passages sorted by core, id, row and place: which strings repeat an earlier one.

    A row for each passage, a column for each offset of its half.
    """
    n = len(c["core"])
    out = np.zeros((n, HALF), bool)
    if not n:
        return out
    low, high = c["low"].astype(np.int64), c["high"].astype(np.int64)
    size = high - low + LENGTH
    base = np.where(low >= HALF, HALF, 0)
    column = np.arange(HALF)
    covers = (column >= (low - base)[:, None]) & (column <= (high - base)[:, None])
    value = (low * 256 + high).astype(np.uint64)
    for depth in range(0, int(size.max()), 8):
        value = textnum.mixed(value + _words(flat, start, size, np.full(n, depth)))
    new = np.ones(n, bool)
    new[1:] = c["core"][1:] != c["core"][:-1]
    group = np.cumsum(new) - 1
    differs = np.zeros(n, bool)
    differs[1:] = ~new[1:] & (value[1:] != value[:-1])
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[differs]] = True
    # Passages of a core that all agree: one comparison holds for all their strings.
    alike = np.flatnonzero(~mixed[group])
    whole = _repeats(group[alike], c["okey"][alike], c["row"][alike], c["at"][alike])
    out[alike] = covers[alike] & whole[:, None]
    rest = np.flatnonzero(mixed[group])
    if not len(rest):
        return out
    # Sort one passage of each kind, rightwards and leftwards from the anchor.
    kind_order = np.lexsort((value[rest], group[rest]))
    changed = np.ones(len(rest), bool)
    sorted_group, sorted_value = group[rest][kind_order], value[rest][kind_order]
    changed[1:] = (sorted_group[1:] != sorted_group[:-1]) | (sorted_value[1:] != sorted_value[:-1])
    kind = np.empty(len(rest), np.int64)
    kind[kind_order] = np.cumsum(changed) - 1
    example = rest[kind_order[changed]]
    own = group[example]
    right = deep_shallow(flat, start[example] + high[example], LENGTH - low[example], own)
    back = flat[::-1]
    left = deep_shallow(back, len(flat) - (start[example] + high[example]), high[example], own)
    # Documents in order, once for all offsets.
    for offset in range(OFFSETS):
        own_half = (offset >= HALF) == (base[rest] > 0)
        places = np.flatnonzero(own_half & (low[rest] <= offset) & (high[rest] >= offset))
        if not len(places):
            continue
        runs = []
        for side, least in ((right, LENGTH - offset), (left, offset)):
            run = np.empty(len(example), np.int64)
            fresh = side.common < least
            fresh[1:] |= own[side.order][1:] != own[side.order][:-1]
            fresh[:1] = True
            run[side.order] = np.cumsum(fresh)
            runs.append(run)
        pair = (runs[0] * (len(example) + 1) + runs[1])[kind[places]]
        by = np.argsort(pair, kind="stable")
        at = rest[places[by]]
        repeat = _repeats(pair[by], c["okey"][at], c["row"][at], c["at"][at])
        out[at[repeat], offset - (HALF if offset >= HALF else 0)] = True
    return out


def _sort_passages(table: pa.Table, parts: int) -> pa.Table:
    """The ranges that repeat earlier ones, by the part of their document."""
    blobs, others = _split(table, "text")
    c, contents = _unpacked(blobs, _FIELDS)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    size = c["high"].astype(np.int64) - c["low"] + LENGTH
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    order = np.lexsort((c["at"], c["row"], c["okey"], c["core"]))
    c = {name: column[order] for name, column in c.items()}
    repeat = _compare(c, flat, start[order])
    edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    first, last = np.nonzero(edge == 1), np.nonzero(edge == -1)
    own = first[0]
    base = np.where(c["low"][own] >= HALF, HALF, 0)
    at = c["at"][own].astype(np.int64)
    span = {
        "okey": c["okey"][own], "row": c["row"][own],
        "start": at - (last[1] - 1 + base), "end": at - (first[1] + base) + LENGTH,
    }
    rows = others + [("span", p, b) for p, b in _dealt(_document_part(span["okey"], span["row"], parts), span, _SPANS)]
    return pa.Table.from_batches([_kind(rows)])


def _pack_documents(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in textnum.blocks(batches):
        part = _document_part(batch.column("okey").to_numpy(), batch.column("row").to_numpy(), parts)
        text = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), batch.column("okey"), batch.column("row"), batch.column("key"), pa.array(text, pa.binary())],
            ["part", "okey", "row", "key", "text"],
        )


def _by_document(c: dict[str, np.ndarray]) -> tuple[dict[tuple[int, int], tuple[int, int]], np.ndarray]:
    """Where each document's rows are in an order by document."""
    order = np.lexsort((c["row"], c["okey"]))
    okey, row = c["okey"][order], c["row"][order]
    new = np.ones(len(order), bool)
    new[1:] = (okey[1:] != okey[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order))
    return {(int(k), int(r)): (a, b) for k, r, a, b in zip(okey[begin], row[begin], begin, end)}, order


def _send_passages(documents: pa.Table, wanted: pa.Table, parts: int) -> pa.Table:
    """The bytes of the passages with repeated cores, by the part of the core."""
    blobs, others = _split(wanted, "core")
    c, _ = _unpacked(blobs, _FIELDS)
    where, order = _by_document(c)
    unpack, part = zstandard.ZstdDecompressor(), _core_part(c["core"], parts)
    dealt: dict[int, tuple[list, list]] = {}
    seen = set()
    for okey, row, blob in zip(*(documents.column(k).to_pylist() for k in ("okey", "row", "text"))):
        if (okey, row) not in where or (okey, row) in seen:
            continue
        seen.add((okey, row))  # rows that agree in all count as one
        a, b = where[okey, row]
        text = unpack.decompress(blob)
        for i in order[a:b].tolist():
            at, low, high = int(c["at"][i]), int(c["low"][i]), int(c["high"][i])
            places, bytes_ = dealt.setdefault(int(part[i]), ([], []))
            places.append(i)
            bytes_.append(text[at - high : at - low + LENGTH])
    rows = others + [
        ("text", p, _packed({name: c[name][places] for name, _ in _FIELDS}, b"".join(bytes_)))
        for p, (places, bytes_) in sorted(dealt.items())
    ]
    return pa.Table.from_batches([_kind(rows)])


def _drop(documents: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of every document of a part."""
    c, _ = _unpacked(spans.column("blob").to_pylist(), _SPANS)
    where, order = _by_document(c)
    unpack = zstandard.ZstdDecompressor()
    out = []
    for okey, row, key, blob in zip(*(documents.column(k).to_pylist() for k in ("okey", "row", "key", "text"))):
        text = unpack.decompress(blob)
        a, b = where.get((okey, row), (0, 0))
        merged = merge(c["start"][order[a:b]], c["end"][order[a:b]])
        at, left = 0, []
        for start, end in merged:
            left.append(text[at:start])
            at = end
        left.append(text[at:])
        kept = b"".join(left)
        out.append((key, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [
            {"start": s, "end": e} for s, e in merged
        ]))
    columns = list(zip(*out)) if out else [()] * 6
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (documents.schema.field("key").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
    return pa.table(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)],
        names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
    )


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges of overlapping or touching ones."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return list(zip(start[new].tolist(), reach[last].tolist()))


_PACKED = "kind string, part long, blob binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, spans)``, one row per document.

    ``key`` holds whole numbers.  ``spans`` are the removed byte ranges, so the remaining
    text follows from a document and its row.
    """
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("okey"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"),
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    documents = rows.mapInArrow(
        lambda it: _pack_documents(it, parts), "part long, okey long, row long, key long, text binary"
    ).groupBy("part")
    found = rows.mapInArrow(lambda it: _find(it, parts), _PACKED)
    repeated = found.groupBy("part").applyInArrow(lambda t: _repeated_cores(t, parts), _PACKED)
    sent = documents.cogroup(repeated.groupBy("part")).applyInArrow(lambda d, w: _send_passages(d, w, parts), _PACKED)
    spans = sent.groupBy("part").applyInArrow(lambda t: _sort_passages(t, parts), _PACKED)
    out = documents.cogroup(spans.groupBy("part")).applyInArrow(
        _drop, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>"
    )
    return out.withColumnRenamed("key", key)
