"""Exact dedup against a history, by a minimal perfect hash over its distinct digests.

Rows are reduced to the digest of their normalised text, and digests to one row per
text with map-side sums, so a text that a third of all rows share is a single row when
it is shuffled.  The history's distinct digests are dealt into parts of a few thousand.
Each part gets a minimal perfect hash: level bitmaps that give every digest of the part
a slot of its own, with no gaps.  A slot holds the full digest and where the winner is
found.  New digests go to the part they belong to, ask for their slot, and are repeats
only if all bytes of the slot's digest agree; the others form groups of their own.

Defined results: null text counts as empty; a null id never wins against another id;
rows with one id and equal texts share one answer; empty tables give empty tables.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.operators.staging import stage

#: Digests of one part, on average.
PART_KEYS = 4096
#: Cells of a level's bitmap for each digest that is still without a slot.
CELLS = 2
_GROUP = "digest string, winner long, copies long, member boolean"
_SLOTS = "part long, slot long, digest string, winner long, copies long, levels binary"


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(
        text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    ).otherwise(text)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """``(digest, winner, copies)`` of rows ``(key, digest)``."""
    return rows.groupBy("digest").agg(F.min("key").alias("winner"), F.count("*").alias("copies"))


def _hashes(digest: list[str]) -> np.ndarray:
    """Two 64-bit words of every digest; digests are uniform, so these are hashes already."""
    words = np.frombuffer(b"".join(map(bytes.fromhex, digest)), ">u8").reshape(-1, 4)
    return words[:, 2:].astype(np.uint64)


def _cell(words: np.ndarray, level: int, cells: int) -> np.ndarray:
    mixed = words[:, 0] + np.uint64(level) * (words[:, 1] | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed % np.uint64(cells)


def perfect_hash(digest: list[str]) -> list[np.ndarray]:
    """Level bitmaps: a digest lives on the first level on which no other falls into its cell."""
    words, levels = _hashes(digest), []
    while len(words):
        cells = max(2, CELLS * len(words))
        cell = _cell(words, len(levels), cells)
        alone = np.bincount(cell.astype(np.int64), minlength=cells) == 1
        levels.append(alone)
        words = words[~alone[cell.astype(np.int64)]]
    return levels


def slots_of(digest: list[str], levels: list[np.ndarray]) -> np.ndarray:
    """Each digest's slot: how many cells are set before its own; -1 if no level has it."""
    slot, before = np.full(len(digest), -1, np.int64), 0
    words, left = _hashes(digest), np.arange(len(digest))
    for k, bits in enumerate(levels):
        if not len(left):
            break
        cell = _cell(words[left], k, len(bits)).astype(np.int64)
        here = bits[cell]
        slot[left[here]] = before + (np.cumsum(bits) - 1)[cell[here]]
        before += int(bits.sum())
        left = left[~here]
    return slot


def _packed(levels: list[np.ndarray]) -> bytes:
    sizes = np.array([len(levels), *map(len, levels)], np.int64)
    return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n + 1)[1:], 8 * (n + 1), []
    for size in sizes:
        length = (int(size) + 7) // 8
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=int(size)).astype(bool))
        at += length
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digest = pdf["digest"].tolist()
    levels = perfect_hash(digest)
    out = pdf.assign(slot=slots_of(digest, levels), levels=None)
    head = {"part": pdf["part"].iloc[0], "slot": -1, "levels": _packed(levels)}
    out["winner"] = out["winner"].astype("Int64")
    return pd.concat([out, pd.DataFrame([head])], ignore_index=True)[
        ["part", "slot", "digest", "winner", "copies", "levels"]
    ]


class DigestIndex(NamedTuple):
    """A history's digests: ``slots`` has a row for each slot, and one at slot -1 with the levels."""

    slots: DataFrame
    parts: int


def _part(digest: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(parts))


def build_index(history: DataFrame, parts: int) -> DigestIndex:
    """The index of distinct digests ``(digest, winner, copies)``, one hash function per part."""
    rows = history.select(_part(F.col("digest"), parts).alias("part"), "digest", "winner", "copies")
    return DigestIndex(rows.groupBy("part").applyInPandas(_build, _SLOTS), parts)


def _absorb(slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    head = slots["slot"] == -1
    kept = slots[~head].sort_values("slot", ignore_index=True)
    old_winner, copies = kept["winner"].astype("Int64"), kept["copies"].astype("int64").to_numpy().copy()
    out = []
    if len(new):
        digest = new["digest"].tolist()
        levels = _unpacked(slots.loc[head, "levels"].iloc[0]) if head.any() else []
        slot = slots_of(digest, levels)
        there = kept["digest"].to_numpy()
        member = np.array([s >= 0 and there[s] == d for s, d in zip(slot, digest)], bool)
        winner = new["winner"].astype("Int64")
        found = pd.Series(winner[member].to_numpy(), index=slot[member], dtype="Int64")
        old_winner = pd.concat([old_winner, found.reindex(old_winner.index)], axis=1).min(axis=1)
        np.add.at(copies, slot[member], new["copies"].to_numpy()[member])
        alone = ~member
        out.append(pd.DataFrame({
            "digest": new["digest"][alone], "winner": winner[alone], "copies": new["copies"][alone], "member": False,
        }))
    out.append(pd.DataFrame({"digest": kept["digest"], "winner": old_winner.astype("Int64"), "copies": copies, "member": True}))
    return pd.concat(out, ignore_index=True)


def absorb(index: DigestIndex, new: DataFrame) -> DataFrame:
    """Groups ``(digest, winner, copies, member)`` of history and new digests together.

    ``member`` tells groups that the history holds from those that only the new rows
    form.  The index should have as many parts as the larger side asks for; rebuild it
    with more parts when a batch outgrows it.
    """
    rows = new.select(_part(F.col("digest"), index.parts).alias("part"), "digest", "winner", "copies")
    return index.slots.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(_absorb, _GROUP)


def exact_groups(history: DataFrame, new: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """Groups of two tables of rows ``(key, digest)``, the first indexed, the second looked up."""
    old, fresh = stage(distinct_digests(history)), stage(distinct_digests(new))
    parts = max(1, -(-max(old.count(), fresh.count()) // part_keys))
    return absorb(build_index(old, parts), fresh)


def exact_dedup(
    docs: DataFrame, is_history: Column, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``(key, keep_id, group_size, kept, text_sha256)``.

    ``is_history`` splits the documents into those that are indexed and those that are
    looked up; the answer is the same for any split.
    """
    rows = stage(docs.select(
        F.col(key).alias("key"), F.coalesce(is_history, F.lit(False)).alias("old"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
    ))
    groups = exact_groups(rows.filter("old"), rows.filter("NOT old"))
    return rows.drop("old").join(groups, "digest").select(
        F.col("key").alias(key),
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("key").eqNullSafe(F.col("winner")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, is_history: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct text."""
    decided = exact_dedup(docs, is_history, key, text).filter("kept").select(
        F.col("keep_id").alias("_winner"), F.col("text_sha256").alias("_sha")
    ).distinct()
    # The row travels as one column: its own names may be anything.
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.sha2(normalised(F.col(text)), 256).alias("_digest"))
    joined = named.join(
        decided, (F.col("_digest") == F.col("_sha")) & F.col("_row")[key].eqNullSafe(F.col("_winner"))
    )
    return joined.dropDuplicates(["_sha", "_winner"]).select("_row.*")
