"""Texts as arrays: helpers that run inside tasks, on one bounded block of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_UNITS = 0x110000


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a column, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def codes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows, a line end after each, and where each row starts."""
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in rows], out=starts[1:])
    flat = ("\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, "<u4"), starts


@lru_cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(_UNITS)), bool, _UNITS)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true cells."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(base, size)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any range follows; values are spread first."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + np.uint64(_BASE)) * _power(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``[a, b)``: equal for equal content, wherever it stands."""
    inverse = pow(_BASE, -1, 1 << 64)
    return mixed((prefix[b] - prefix[a]) * _power(inverse, len(prefix))[a] + (b - a).astype(np.uint64))
