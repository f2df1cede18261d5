"""Sampled SentencePiece segmentations without replacement, by Gumbel top-k, and decoding.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces.  The
``k`` best under Gumbel noise are a sample without replacement by probability.  They are
found by an A-star search over perturbed bounds: the noise of a whole set of paths is one
Gumbel draw at the logarithm of the set's mass, which backward sums give exactly, so the
bound of a set is the value of its best path.  The best set is opened along one sampled
path; at every node of the path the paths that leave it there form a new set, whose value
is a Gumbel draw held below its parent's.  The next sample opens the set with the highest
value.  After ``k`` samples the highest value left is the threshold of the inclusion
scores: the logarithm of one minus exp(-exp(log_prob - threshold)).

A vocabulary of byte-pair merges has ranks, not probabilities; a piece of rank r gets
the Zipf weight 1 / (r + RANK_SHIFT).  Signs that no piece holds become bytes.  Lattices
are built once for each distinct word of a block of rows.

All noise comes from the row's key, the place in the text and the number of the sample,
so a row is segmented alike in any batch.  Defined results: null and empty texts have one
segmentation, the empty one; a text with fewer than ``k`` segmentations gives all it has,
with inclusion score 0 (certain); rows that share a key share the noise; empty tables
give empty tables.  Memory in a task grows with the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm import textnum

#: The sign pieces use for a space, and what stands for it in a text itself.
SPACE, LITERAL = 0x2581, 0x110000
RANK_SHIFT = 10.0
#: Bytes are that much less likely than the last piece, each.
BYTE_PRICE = 1.0
#: Distinct segmentations of a text.
SAMPLES = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_SCHEMA = (
    "key {kind}, sample int, n_pieces int, ids array<int>, log_prob double, gumbel double, log_inclusion double"
)


class Vocabulary(NamedTuple):
    """Pieces by id, their log weights, and tables to find a piece by the hash of its signs."""

    pieces: list[str]
    log_p: np.ndarray
    byte_ids: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray]]  # sorted hashes and ids of pieces of length 1, 2, ...
    begun: np.ndarray  # which top bits the hashes of beginnings of pieces have
    alone: np.ndarray  # signs that occur in no piece of two or more

    @property
    def byte_log_p(self) -> float:
        return -float(np.log(len(self.pieces) + RANK_SHIFT)) - BYTE_PRICE


def _signs(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text], np.uint64)


def _spread(code: np.ndarray) -> np.ndarray:
    return textnum.mixed(code.astype(np.uint64) + _BASE)


def _beginnings(signs: np.ndarray) -> list[int]:
    """Hashes of the first sign, the first two, and so on."""
    out, total = [], 0
    for value in _spread(signs).tolist():
        total = (total * int(_BASE) + value) % 2**64
        out.append(total)
    return out


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; read on the driver, sent to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    rank = np.where(score < -n, n, -score)
    return vocabulary(pieces, plain, -np.log(rank + RANK_SHIFT), byte_ids)


def vocabulary(pieces: list[str], plain: list[int], log_p: np.ndarray, byte_ids: np.ndarray) -> Vocabulary:
    """Tables over the pieces with ids ``plain``."""
    lengths: dict[int, list[tuple[int, int]]] = {}
    begun = np.zeros(1 << _FILTER_BITS, bool)
    alone = np.ones(LITERAL + 1, bool)
    for i in plain:
        signs = _signs(pieces[i])
        values = _beginnings(signs)
        lengths.setdefault(len(signs), []).append((values[-1], i))
        for value in values:
            begun[value >> (64 - _FILTER_BITS)] = True
        if len(signs) > 1:
            alone[signs.astype(np.int64)] = False
    alone[SPACE] = False
    by_length = []
    for length in range(1, max(lengths) + 1):
        rows = sorted(lengths.get(length, []))
        by_length.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32)))
    return Vocabulary(pieces, log_p, byte_ids, by_length, begun, alone)


class Block(NamedTuple):
    """The rows of a block as signs, cut into words."""

    code: np.ndarray
    starts: np.ndarray  # of the rows, and the end
    begin: np.ndarray  # of the words
    end: np.ndarray
    row: np.ndarray  # of the words


def cut(rows: list[str], vocab: Vocabulary) -> Block:
    """Words start at a run of spaces, and around signs that no longer piece holds."""
    code, starts = textnum.codes([" " + t if t else "" for t in rows])
    code = np.where(code == SPACE, LITERAL, code)
    code = np.where(code == 32, SPACE, code)
    ends = starts[1:] - 1
    inside = np.ones(len(code), bool)
    inside[ends] = False
    space, alone = code == SPACE, vocab.alone[code]
    first = space | alone
    first[1:] &= ~space[:-1] | alone[1:]
    first[1:] |= alone[:-1] | ~inside[:-1]
    first[:1] = True
    begin = np.flatnonzero(first & inside)
    # A word ends where the next begins, or where its row ends.
    row = np.searchsorted(starts, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(code)), ends[row])
    return Block(code, starts, begin, end, row)


class Lattice(NamedTuple):
    """Nodes of all distinct words, ordered by how many signs are left; edges by node, longest first."""

    left: np.ndarray  # signs left at a node
    first: np.ndarray  # a node's first edge; one more at the end
    to: np.ndarray
    log_p: np.ndarray  # of an edge, given its node
    upto: np.ndarray  # summed probability of a node's edges up to this one
    ids: np.ndarray  # ids of all edges, one after the other
    ids_at: np.ndarray
    start: np.ndarray  # the first node of each word


def build(words: list[np.ndarray], vocab: Vocabulary) -> Lattice:
    """The lattice of distinct words, given as arrays of signs."""
    size = np.array([len(w) + 1 for w in words])
    flat = np.zeros(int(size.sum()), np.int64)
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    keep = np.ones(len(flat), bool)
    keep[offset + size - 1] = False
    flat[keep] = np.concatenate(words)
    left = np.repeat(offset + size - 1, size) - np.arange(len(flat))
    narrow = left.astype(np.int16) if left.max() < 1 << 15 else left
    order = np.argsort(narrow, kind="stable")
    node = np.empty(len(flat), np.int64)
    node[order] = np.arange(len(flat))
    spread, at = _spread(flat), np.flatnonzero(left)
    value, found = np.zeros(len(at), np.uint64), []
    for length, (hashes, ids) in enumerate(vocab.by_length, 1):
        value = value * _BASE + spread[at + length - 1]
        begun = vocab.begun[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        at, value = at[begun], value[begun]
        if len(hashes):
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = hashes[place] == value
            found.append((at[hit], length, ids[place[hit]]))
        longer = left[at] > length
        at, value = at[longer], value[longer]
    single = np.zeros(len(flat), bool)
    for at, length, _ in found:
        if length == 1:
            single[at] = True
    raw = np.flatnonzero(~single & (left > 0))
    count = np.zeros(len(flat) + 1, np.int64)
    for at, _, _ in found:
        count[node[at] + 1] += 1
    count[node[raw] + 1] += 1
    first = np.cumsum(count)
    total = int(first[-1])
    to, weight, piece = np.empty(total, np.int64), np.empty(total), np.full(total, -1, np.int64)
    fill = first[:-1].copy()
    for at, length, ids in reversed(found):
        own = node[at]
        edge = fill[own]
        to[edge], weight[edge], piece[edge] = node[at + length], vocab.log_p[ids], ids
        fill[own] += 1
    byte_ids = [_bytes(int(c), vocab) for c in flat[raw]]
    edge = fill[node[raw]]
    to[edge], piece[edge] = node[raw + 1], -1
    weight[edge] = vocab.byte_log_p * np.array([len(b) for b in byte_ids])
    length = np.ones(total, np.int64)
    length[edge] = [len(b) for b in byte_ids]
    ids_at = np.concatenate([[0], np.cumsum(length)])
    ids = np.empty(int(ids_at[-1]), np.int32)
    whole = piece >= 0
    ids[ids_at[:-1][whole]] = piece[whole]
    for e, own in zip(edge, byte_ids):
        ids[ids_at[e] : ids_at[e] + len(own)] = own
    log_p = _conditional(left[order], first, to, weight)
    upto = np.cumsum(np.exp(log_p))
    before = np.repeat(np.concatenate([[0.0], upto])[first[:-1]], np.diff(first))
    upto -= before
    upto[first[1:][np.diff(first) > 0] - 1] = 2.0
    return Lattice(left[order], first, to, log_p, upto, ids, ids_at, node[offset])


def _bytes(sign: int, vocab: Vocabulary) -> np.ndarray:
    text = chr(SPACE if sign == LITERAL else sign)
    return vocab.byte_ids[list(text.encode("utf-8", "surrogatepass"))]


def _conditional(left: np.ndarray, first: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log probability of every edge given its node, by sums from the ends of the words."""
    mass = np.zeros(len(left))
    log_p = np.empty(len(to))
    levels = np.searchsorted(left, np.arange(int(left[-1]) + 2))
    for a, b in zip(levels[1:-1], levels[2:]):
        i, j = first[a], first[b]
        start, n = first[a:b] - i, np.diff(first[a : b + 1])
        value = weight[i:j] + mass[to[i:j]]
        top = np.maximum.reduceat(value, start)
        mass[a:b] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), start))
        log_p[i:j] = value - np.repeat(mass[a:b], n)
    return np.minimum(log_p, 0.0)


def _uniform(seed: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing else."""
    x = textnum.mixed(textnum.mixed(seed + np.uint64(salt)) + place.astype(np.uint64) * _BASE)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _walk(lattice: Lattice, node: np.ndarray, word_end: np.ndarray, seed: np.ndarray, start: np.ndarray, salt: int, out: np.ndarray) -> None:
    """Samples a path to the end of each word; ``out`` gets the edge taken at each place."""
    while True:
        open_ = np.flatnonzero(lattice.left[node])
        if not len(open_):
            return
        node, word_end, seed, start = node[open_], word_end[open_], seed[open_], start[open_]
        place = word_end - lattice.left[node]
        u = _uniform(seed, place - start, salt)
        edge = lattice.first[node]
        more = np.flatnonzero(u > lattice.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] > lattice.upto[edge[more]]]
        out[place] = edge
        node = lattice.to[edge]


class Path(NamedTuple):
    """The sampled paths of all rows that got one, and the sets that leave them."""

    place: np.ndarray
    edge: np.ndarray
    row: np.ndarray
    before: np.ndarray  # log probability up to a node
    bound: np.ndarray  # the value of the set that leaves here
    whole: np.ndarray  # log probability of each row's path


def _log_rest(log_p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(log_p))
    return np.where(log_p > -1e-12, -np.inf, rest)


def _below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at a location, held below ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = location - np.logaddexp(location - top, np.log(-np.log(u)))
    return np.where(np.isneginf(location), -np.inf, np.minimum(out, top))


def _path(lattice: Lattice, block: Block, taken: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    place = np.flatnonzero(taken >= 0)
    edge = taken[place]
    cuts = np.searchsorted(place, block.starts)
    row = np.repeat(np.arange(rows), np.diff(cuts))
    log_p = lattice.log_p[edge]
    total = np.concatenate([[0.0], np.cumsum(log_p)])
    before = total[:-1] - total[cuts[:-1]][row]
    return place, edge, row, before, total[cuts[1:]] - total[cuts[:-1]]


def sample(rows: list[str], seeds: np.ndarray, vocab: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row, up to ``k`` of ``(ids, log_prob, gumbel, log_inclusion)``, best first."""
    n = len(rows)
    block = cut(rows, vocab)
    out: list[list] = [[] for _ in range(n)]
    if not len(block.begin):
        return [[(np.zeros(0, np.int32), 0.0, float(-np.log(-np.log(u))), 0.0)] for u in _uniform(seeds, np.zeros(n), 0)]
    value = textnum.range_hash(textnum.prefix_hash(block.code), block.begin, block.end)
    _, example, kind = np.unique(value, return_index=True, return_inverse=True)
    lattice = build([block.code[block.begin[i] : block.end[i]] for i in example], vocab)
    top = -np.log(-np.log(_uniform(seeds, np.zeros(n), 0)))
    taken = np.full(len(block.code), -1, np.int64)
    _walk(lattice, lattice.start[kind], block.end, seeds[block.row], block.starts[block.row], 1, taken)
    paths: list[Path] = []
    excluded: dict[tuple[int, int], list[int]] = {}
    for number in range(k):
        place, edge, row, before, whole = _path(lattice, block, taken, n)
        rest = before + _log_rest(lattice.log_p[edge])
        bound = _below(rest, top[row], _uniform(seeds[row], place - block.starts[row], 1000 + number))
        if number:
            # Nodes before the branch belong to the path it left; the branch itself is updated there.
            bound[place <= branch[row]] = -np.inf
        paths.append(Path(place, edge, row, before, bound, whole))
        live = np.isfinite(top)
        ids, cuts = _ids(lattice, edge, row, n)
        for i in np.flatnonzero(live):
            out[i].append([ids[cuts[i] : cuts[i + 1]], float(whole[i]), float(top[i]), 0.0])
        best, which, index = _best(paths, n)
        if number == k - 1:
            threshold = best
            break
        taken = taken.copy()
        top, branch = best, np.full(n, -1, np.int64)
        nodes, words = [], []
        for i in np.flatnonzero(np.isfinite(best)):
            source, at = paths[which[i]], int(index[i])
            if not (which[i] == number):
                _restore(taken, source, block, int(i))
            gone = excluded.setdefault((int(which[i]), at), [int(source.edge[at])])
            where = int(source.place[at])
            here = np.array([where - block.starts[i]])
            chosen, rest_mass = _other(lattice, gone, _uniform(seeds[i : i + 1], here, 2000 + number)[0])
            gone.append(chosen)
            u = _uniform(seeds[i : i + 1], here, 3000 + number)
            source.bound[at] = _below(np.array([source.before[at] + rest_mass]), best[i : i + 1], u)[0]
            taken[where + 1 : block.starts[i + 1]] = -1
            taken[where] = chosen
            branch[i] = where
            nodes.append(int(lattice.to[chosen]))
            words.append(int(np.searchsorted(block.begin, where, side="right")) - 1)
        later = np.flatnonzero((block.begin > branch[block.row]) & (branch[block.row] >= 0))
        word = np.concatenate([later, np.array(words, np.int64)])
        node = np.concatenate([lattice.start[kind[later]], np.array(nodes, np.int64)])
        _walk(lattice, node, block.end[word], seeds[block.row[word]], block.starts[block.row[word]], number + 2, taken)
    for i in range(n):
        for one in out[i]:
            one[3] = _log_inclusion(one[1] - threshold[i])
    return [[tuple(one) for one in row] for row in out]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 700:
        return 0.0
    rate = float(np.exp(x))
    return float(np.log(-np.expm1(-rate))) if rate > 1e-300 else float(x)


def _other(lattice: Lattice, gone: list[int], u: float) -> tuple[int, float]:
    """An edge of the same node that has not been taken, and the log mass of those left after it."""
    node = int(np.searchsorted(lattice.first, gone[0], side="right")) - 1
    edges = np.arange(lattice.first[node], lattice.first[node + 1])
    edges = edges[~np.isin(edges, gone)]
    p = np.exp(lattice.log_p[edges] - lattice.log_p[edges].max())
    chosen = min(int(np.searchsorted(np.cumsum(p), u * p.sum())), len(p) - 1)
    rest = np.delete(lattice.log_p[edges], chosen)
    return int(edges[chosen]), float(np.logaddexp.reduce(rest)) if len(rest) else -np.inf


def _restore(taken: np.ndarray, path: Path, block: Block, row: int) -> None:
    a, b = np.searchsorted(path.place, block.starts[row : row + 2])
    taken[block.starts[row] : block.starts[row + 1]] = -1
    taken[path.place[a:b]] = path.edge[a:b]


def _best(paths: list[Path], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's highest value over all sets, the path and place it belongs to."""
    best, which, index = np.full(rows, -np.inf), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for number, path in enumerate(paths):
        cuts = np.searchsorted(path.row, np.arange(rows + 1))
        full = np.flatnonzero(np.diff(cuts))
        if not len(full):
            continue
        high = np.full(rows, -np.inf)
        high[full] = np.maximum.reduceat(path.bound, cuts[full])
        at = np.flatnonzero((path.bound == high[path.row]) & np.isfinite(path.bound))
        better = high > best
        for i, j in zip(path.row[at][::-1], at[::-1]):
            if better[i]:
                index[i] = j
        best[better], which[better] = high[better], number
    return best, which, index


def _ids(lattice: Lattice, edge: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all paths, and where each row's begin."""
    first, n = lattice.ids_at[edge], lattice.ids_at[edge + 1] - lattice.ids_at[edge]
    if (n == 1).all():
        return lattice.ids[first], np.searchsorted(row, np.arange(rows + 1))
    start = np.concatenate([[0], np.cumsum(n)])
    flat = np.repeat(first - start[:-1], n) + np.arange(start[-1])
    return lattice.ids[flat], start[np.searchsorted(row, np.arange(rows + 1))]


def _encode(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, k: int) -> Iterator[pa.RecordBatch]:
    for batch in textnum.blocks(batches):
        seeds = batch.column("seed").to_numpy().view(np.uint64)
        found = sample(textnum.texts(batch), seeds, vocab, k)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = [one for f in found for one in f]
        size = [len(one[0]) for one in flat]
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        ids = pa.array(np.concatenate([one[0] for one in flat]) if flat else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(pa.array(row)),
                pa.array(np.concatenate([np.arange(1, len(f) + 1) for f in found]).astype(np.int32)),
                pa.array(size, pa.int32()), pa.ListArray.from_arrays(cuts, ids),
                *(pa.array([one[c] for one in flat], pa.float64()) for c in (1, 2, 3)),
            ],
            ["key", "sample", "n_pieces", "ids", "log_prob", "gumbel", "log_inclusion"],
        )


def encode(docs: DataFrame, vocab: Vocabulary, k: int = SAMPLES, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sample, n_pieces, ids, log_prob, gumbel, log_inclusion)``: up to ``k`` rows per document."""
    kept = docs.sparkSession.sparkContext.broadcast(vocab)
    own = F.col(key) if isinstance(key, str) else key
    rows = docs.select(own.alias("key"), F.xxhash64(own).alias("seed"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _encode(it, kept.value, k), _SCHEMA.format(kind=kind))


def _spelled(vocab: Vocabulary) -> pa.Array:
    """What every id stands for, in bytes."""
    out = [piece.replace(chr(SPACE), " ").encode() for piece in vocab.pieces]
    for byte, own in enumerate(vocab.byte_ids):
        out[int(own)] = bytes([byte])
    return pa.array(out, pa.large_binary())


def decoded(ids: pa.ListArray, spelled: pa.Array) -> pa.Array:
    """The text of every segmentation; the blank that encoding puts first goes."""
    pieces = spelled.take(ids.flatten())
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
    offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)[ends]
    joined = pa.Array.from_buffers(
        pa.large_string(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pieces.buffers()[2]]
    )
    joined.validate(full=True)
    text = pc.utf8_slice_codeunits(joined, 1).cast(pa.string())
    return pc.if_else(ids.is_valid(), text, None) if ids.null_count else text


def _decode(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, ids: str) -> Iterator[pa.RecordBatch]:
    spelled = _spelled(vocab)
    for batch in batches:
        text = decoded(batch.column(ids), spelled)
        yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])


def _round_trip(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, k: int) -> Iterator[pa.RecordBatch]:
    spelled = _spelled(vocab)
    for batch in textnum.blocks(batches):
        given = pc.fill_null(batch.column("text"), "")
        for out in _encode(iter([batch]), vocab, k):
            # The samples of a row follow each other, from 1 on.
            row = np.cumsum(out.column("sample").to_numpy() == 1) - 1
            text = decoded(out.column("ids"), spelled)
            digest = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in text], pa.string())
            exact = pc.equal(text, given.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, digest, exact], [*out.schema.names, "decoded_sha256", "exact"]
            )


def decode(rows: DataFrame, vocab: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows with the text of their segmentation as ``decoded``."""
    kept = rows.sparkSession.sparkContext.broadcast(vocab)
    kind = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(lambda it: _decode(it, kept.value, ids), kind)


def round_trip(docs: DataFrame, vocab: Vocabulary, k: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode`` gives, with the digest of each segmentation's decoded text and whether it is the row's text.

    A null text is encoded, and comes back, as an empty one.  Both ways run in one task, on the
    same batch, so no text is sent a second time.
    """
    kept = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key).alias("seed"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        lambda it: _round_trip(it, kept.value, k), _SCHEMA.format(kind=kind) + ", decoded_sha256 string, exact boolean"
    )
