"""Phrase collocation mining over sorted suffixes.

A suffix pointer stands at every word and sees at most four words, to the end of its piece.
Tasks first add up equal suffixes of their own blocks, then deal what is left by a hash of
the language and the leading words: single words by one word, pairs by two, longer ones by
three.  All occurrences of a phrase meet in one part, and no part holds more of a very
common leading word or pair than of any other: its continuations are dealt apart.

A part stays packed while it is counted: its suffixes are taken up one length at a time, and
if they are many in several passes, each over those whose leading words hash to it.  So what
a task sorts at once does not grow with its part, but for what follows the same three words.

A pass buckets its suffixes by leading word and sorts each bucket by multikey quicksort, all
segments of a depth at once: less than, equal to, greater than the word of a pivot.  The
equal ones go one word deeper, down to the longest phrase; the number of occurrences in an
equal segment is the count of its phrase.  A segment with fewer occurrences than asked for
is abandoned on the spot, whichever side it is on, and most are within a few rounds.

Scores, cuts, phrases within phrases and ranks follow as joins of the counted phrases, which
are fewer than the words of the corpus by the least count.

Defined results: a null text is empty, a null language is ``und``.  Repeated rows count as
often as they stand there; ids are not read.  Words keep their bytes but for A-Z, which are
lower-cased; words of any length are whole.  Equal scores and counts are ordered by the
phrase's bytes.  An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textwarden.llm import textnum
from textwarden.llm.tables import written

#: Bytes of text whose suffixes are added up at once, and suffixes a task holds before it deals them out.
BLOCK_BYTES = 1 << 21
HELD = 1_000_000
#: Text whose suffixes make up one part.
PART_BYTES = 1 << 23
#: Suffixes of a part that are sorted in one pass, on average.
SORTED = 400_000
#: Packed rows of a part below which they are packed anew, with others: many parts make small packs.
FEW = 6_000
#: Bytes of a dictionary that are hashed at once.
HASHED_BYTES = 1 << 17
#: Groups of a language's phrases that are ranked before all of them are.
GROUPS = 32
_END = -1
#: Rows that are sorted by depth: a phrase of so many leading words, and the depths it counts for.
_KINDS = {1: (1,), 2: (2,), 4: (3, 4)}


@lru_cache
def _classes() -> np.ndarray:
    """0 for a byte of a word, 1 for a blank between words, 2 for the end of a piece."""
    out = np.zeros(256, np.uint8)
    out[[0x09, 0x20]] = 1
    out[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
    return out


@lru_cache
def _lowered() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    return out


class Words:
    """The words of a block: their numbers in a dictionary, their language, and who follows whom."""

    def __init__(self, batch: pa.RecordBatch):
        text = batch.column("text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        flat = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        kind = _classes()[flat]
        inside = kind == 0
        head = np.zeros(len(flat) + 1, bool)
        head[offsets - offsets[0]] = True
        head = head[:-1]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | head[1:]
        start = np.flatnonzero(begins)
        where = np.cumsum(inside, dtype=np.int32)  # a column of texts is below 2**31 bytes
        # Words side by side, without what stands between them.
        edges = np.append(where[start] - 1, where[-1] if len(where) else 0)
        data = _lowered()[flat[inside]]
        words = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        self.word = words.indices.to_numpy().astype(np.int64)
        self.dictionary = words.dictionary
        piece = np.cumsum((kind == 2) | head, dtype=np.int32)[start]
        self.follows = np.zeros(len(start), bool)  # the next word stands in the same piece
        self.follows[:-1] = piece[1:] == piece[:-1]
        document = np.searchsorted(offsets - offsets[0], start, "right") - 1
        spoken = batch.column("lang").fill_null("und").dictionary_encode()
        self.languages = spoken.dictionary.to_pylist()
        self.language = spoken.indices.to_numpy().astype(np.int64)[document]


def suffixes(words: Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: distinct rows ``(language, words)`` of a block, filled up with ends, and how often each occurs."""
    w, size = words.word, len(words.dictionary) + 1
    single, of, count = np.unique(words.language * size + w, return_inverse=True, return_counts=True)
    out = {1: (np.stack([single // size, single % size], 1), count)}
    at = np.flatnonzero(words.follows)
    pair, pair_of, count = np.unique(of[at] * size + w[at + 1], return_inverse=True, return_counts=True)
    first = single[pair // size]
    pairs = np.stack([first // size, first % size, pair % size], 1)
    out[2] = (pairs, count)
    # The pair that begins at a word, or no pair.
    begins = np.full(len(w) + 1, -1, np.int64)
    begins[at] = pair_of
    third = at[words.follows[np.minimum(at + 1, len(w) - 1)]]
    tail = begins[third + 2]
    rest = np.where(tail >= 0, size + tail, w[third + 2])
    wide = size + len(pair)
    long, count = np.unique(begins[third] * wide + rest, return_counts=True)
    head, rest = pairs[long // wide], long % wide
    whole = rest >= size
    last = np.where(whole, rest - size, 0)
    ends = pairs[last][:, 1:] if len(pairs) else np.zeros((len(long), 2), np.int64)
    out[4] = (
        np.column_stack([head, np.where(whole, ends[:, 0], rest), np.where(whole, ends[:, 1], _END)]), count
    )
    return out


def _parts(rows: np.ndarray, spoken: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row: by the language and the leading words, three at most."""
    out = spoken[rows[:, 0]]
    for column in range(1, min(rows.shape[1], 4)):
        out = textnum.mixed(out + word[rows[:, column]])
    return (out % np.uint64(parts)).astype(np.int64)


def _pack(rows: dict[int, tuple[np.ndarray, np.ndarray]], dictionary: pa.Array) -> bytes:
    """Rows of a part, numbered by the words they hold, which keep their order; of many, every kind can be read alone."""
    held = np.concatenate([r[:, 1:].ravel() for r, _ in rows.values()])
    if len(held) * 8 < len(dictionary):
        used = np.unique(held)
        used = used[used >= 0]
        rank = lambda ids: np.where(ids >= 0, np.searchsorted(used, ids), _END)
    else:
        there = np.zeros(len(dictionary) + 1, bool)
        there[held] = True  # the end is the last cell
        there[-1] = False
        used, numbers = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - 1
        numbers[-1] = _END
        rank = lambda ids: numbers[ids]
    words = dictionary.take(pa.array(used))
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    frames = [(0, len(words), np.diff(offsets).astype(np.int32).tobytes() + text.tobytes())]
    for kind, (r, count) in rows.items():
        out = []
        for c in range(r.shape[1]):
            column = r[:, c] if c == 0 else rank(r[:, c])
            # Leading words rise, but for where a block begins.
            out.append((np.diff(column, prepend=0) if c == 1 else column).astype(np.int32).tobytes())
        frames.append((kind, len(r), b"".join([*out, count.astype(np.int64).tobytes()])))
    raws = [raw for _, _, raw in frames]
    if sum(len(r) for r, _ in rows.values()) < FEW:
        raws = [b"".join(raws)]
    packed = [pa.compress(raw, codec="zstd", asbytes=True) for raw in raws]
    heads = [(kind, n, len(raw), len(z)) for (kind, n, raw), z in zip_longest(frames, packed, fillvalue=b"")]
    return b"".join([np.array([len(heads), *sum(heads, ())], np.int64).tobytes(), *packed])


class _Packed:
    """What ``_pack`` gives: its words, and its rows by kind, unpacked when asked for."""

    def __init__(self, blob: pa.Buffer):
        frames = np.frombuffer(blob, np.int64, 1)[0]
        heads = np.frombuffer(blob, np.int64, 4 * frames, 8).reshape(-1, 4).copy()
        self.blob = blob.slice(8 + 32 * int(frames))
        self.together = not heads[-1, 3]  # packed as one
        if self.together:
            self.blob = pa.decompress(self.blob, int(heads[:, 2].sum()), codec="zstd")
            heads[:, 3] = heads[:, 2]
        at = np.append(0, np.cumsum(heads[:, 3])).tolist()
        self.frames = {kind: (n, raw, a, z) for (kind, n, raw, z), a in zip(heads.tolist(), at)}

    def size(self, kind: int) -> int:
        return self.frames[kind][0] if kind in self.frames else 0

    def _raw(self, kind: int) -> pa.Buffer:
        _, raw, a, z = self.frames[kind]
        frame = self.blob.slice(a, z)
        return frame if self.together else pa.py_buffer(pa.decompress(frame, raw, codec="zstd", asbytes=True))

    def words(self) -> pa.Array:
        raw, n = self._raw(0), self.size(0)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int64)])
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), raw.slice(4 * n)])

    def rows(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        raw, size = self._raw(kind), self.size(kind)
        rows = np.empty((size, kind + 1), np.int32)
        for c in range(kind + 1):
            rows[:, c] = np.frombuffer(raw, np.int32, size, 4 * size * c)
        rows[:, 1] = np.cumsum(rows[:, 1])
        return rows, np.frombuffer(raw, np.int64, size, 4 * size * (kind + 1))


class _Held:
    """Suffixes of some blocks in one numbering, until they are dealt out."""

    def __init__(self) -> None:
        self.dictionaries: list[pa.Array] = []
        self.languages: dict[str, int] = {}
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in _KINDS}
        self.size = self.words = 0

    def add(self, dictionary: pa.Array, languages: list[str], rows: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        spoken = np.array([self.languages.setdefault(name, len(self.languages)) for name in languages] or [0])
        for kind, (r, count) in rows.items():
            r = r.astype(np.int32)
            r[:, 0] = spoken[r[:, 0]] if len(r) else 0
            r[:, 1:][r[:, 1:] >= 0] += self.words
            self.rows[kind].append((r, count))
            self.size += len(r)
        self.dictionaries.append(dictionary)
        self.words += len(dictionary)

    def whole(self) -> tuple[pa.Array, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
        """One dictionary, and by kind, given once, rows numbered by it; rows of different blocks may be equal."""
        encoded = pa.concat_arrays(self.dictionaries).dictionary_encode()
        self.dictionaries = []
        return encoded.dictionary, self._numbered(np.append(encoded.indices.to_numpy(), np.int32(_END)))  # the end stays the end

    def _numbered(self, number: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for kind in _KINDS:
            held = self.rows.pop(kind)
            if not held:
                continue
            rows, count = np.concatenate([r for r, _ in held]), np.concatenate([count for _, count in held])
            held.clear()
            rows[:, 1:] = number[rows[:, 1:]]
            yield kind, rows, count


def _word_hashes(dictionary: pa.Array) -> np.ndarray:
    """Hashes of the words, of a bounded stretch of them at once."""
    data = np.frombuffer(dictionary.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    out = np.empty(len(dictionary), np.uint64)
    a = 0
    while a < len(dictionary):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + HASHED_BYTES, "right")) - 1)
        at = offsets[a : b + 1] - offsets[a]
        out[a:b] = textnum.range_hash(textnum.prefix_hash(data[offsets[a] : offsets[b]]), at[:-1], at[1:])
        a = b
    return out


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Suffixes of a task by part, each with the words it needs."""
    held = _Held()
    for block in textnum.blocks(batches, limit=BLOCK_BYTES):
        words = Words(block)
        if len(words.word):
            held.add(words.dictionary, words.languages, suffixes(words))
        if held.size > HELD:
            yield from _dealt(held, parts)
            held = _Held()
    if held.size:
        yield from _dealt(held, parts)


def _dealt(held: _Held, parts: int) -> Iterator[pa.RecordBatch]:
    dictionary, kinds = held.whole()
    languages = list(held.languages)
    spoken = np.array([zlib.crc32(name.encode("utf-8", "surrogatepass")) for name in languages], np.uint64)
    word = _word_hashes(dictionary)
    cut = {}
    for kind, rows, count in kinds:
        part = _parts(rows, spoken, word, parts)
        # Numbers of 16 bits are sorted by their digits.
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
        cut[kind] = rows[order], count[order], np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = {
            kind: (r[at[p] : at[p + 1]], count[at[p] : at[p + 1]]) for kind, (r, count, at) in cut.items() if at[p] < at[p + 1]
        }
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([languages], pa.list_(pa.string())), pa.array([_pack(own, dictionary)], pa.binary())], ["part", "languages", "blob"]
            )


def frequent(rows: np.ndarray, count: np.ndarray, depths: tuple[int, ...], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(depth, rows, counts)``: phrases that occur often enough, by multikey quicksort of their suffixes.

    A row is a bucket's number, then words; a phrase at a depth is the bucket and as many
    words.  One row of each phrase is given.
    """
    if not len(rows):
        return
    deepest = max(depths)
    order = np.argsort(rows[:, 0], kind="stable")  # into buckets
    weight = count[order]
    segment = rows[order, 0]
    depth = np.zeros(len(order), np.int64)
    equal = np.ones(len(order), bool)  # told from its sides in the last round
    while len(order):
        new = np.ones(len(order), bool)
        new[1:] = segment[1:] != segment[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        often = np.add.reduceat(weight, begin)
        at = depth[begin]
        for d in depths:
            # The sides of a segment keep its depth, but are parts of a phrase already counted.
            hit = (at == d) & (often >= least) & equal[begin]
            yield d, rows[order[begin[hit]], : d + 1], often[hit]
        live = (often >= least) & (at < deepest)
        keep = np.repeat(live, size)
        order, weight, depth = order[keep], weight[keep], depth[keep]
        size = size[live]
        if not len(order):
            return
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        word = rows[order, depth + 1]
        pivot = np.repeat(word[begin + size // 2], size)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        # Places by counting: how many of the segment's rows lie on the sides before, and before in the own one.
        place = np.empty(len(order), np.int64)
        below = begin.copy()
        for s in range(3):
            own = np.cumsum(side == s)
            before = np.concatenate([[0], own])[begin]
            mine = side == s
            place[mine] = (np.repeat(below - before, size) + own - 1)[mine]
            below = below + np.concatenate([[0], own])[begin + size] - before
        number = np.repeat(np.arange(len(size)), size) * 3 + side
        moved = np.empty_like(place)
        moved[place] = np.arange(len(place))
        order, weight, segment = order[moved], weight[moved], number[moved]
        # The end of a piece goes no deeper: nothing longer begins here.
        equal = (side == 1)[moved]
        depth = depth[moved] + equal
        over = equal & (word[moved] == _END)
        if over.any():
            order, weight, segment, depth, equal = (c[~over] for c in (order, weight, segment, depth, equal))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], _Packed]]:
    """Languages and packs of a partition, small packs put together: each is read once a pass."""

    def packed(held: _Held) -> tuple[list[str], _Packed]:
        dictionary, kinds = held.whole()
        return list(held.languages), _Packed(pa.py_buffer(_pack({kind: (r, count) for kind, r, count in kinds}, dictionary)))

    held = _Held()
    for batch in batches:
        for languages, blob in zip(batch.column("languages").to_pylist(), batch.column("blob")):
            p = _Packed(blob.as_buffer())
            if sum(p.size(kind) for kind in _KINDS) >= FEW:
                yield languages, p
                continue
            held.add(p.words(), languages, {kind: p.rows(kind) for kind in _KINDS if p.size(kind)})
            if held.size > SORTED:
                yield packed(held)
                held = _Held()
    if held.size:
        yield packed(held)


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of a partition, which holds whole parts, and its share of each language's words."""
    number: dict[str, int] = {}
    packed, spoken = [], []
    for languages, p in _merged(batches):
        packed.append(p)
        spoken.append(np.array([number.setdefault(name, len(number)) for name in languages], np.int32))
    if not packed:
        return
    encoded = pa.chunked_array([p.words() for p in packed]).dictionary_encode()
    dictionary = encoded.chunk(0).dictionary
    renumbered = [np.append(c.indices.to_numpy(), np.int32(_END)) for c in encoded.chunks]  # the end stays the end
    del encoded
    names = np.array(list(number), object)
    totals = np.zeros(len(names), np.int64)
    size = len(dictionary) + 1
    hashes = textnum.mixed(np.arange(1, size, dtype=np.uint64))
    for kind, depths in _KINDS.items():
        passes = max(1, -(-sum(p.size(kind) for p in packed) // SORTED))
        for turn in range(passes):
            held = []
            for p, languages, words in zip(packed, spoken, renumbered):
                if not p.size(kind):
                    continue
                r, count = p.rows(kind)
                r[:, 0] = languages[r[:, 0]]
                r[:, 1:] = words[r[:, 1:]]
                if passes > 1:
                    own = np.flatnonzero(_parts(r, np.arange(len(names), dtype=np.uint64), hashes, passes) == turn)
                    r, count = r[own], count[own]
                held.append((r, count))
            if not held:
                continue
            # The bucket: a language and a leading word; the sort begins one word deep.
            bucket = np.concatenate([np.column_stack([r[:, 0].astype(np.int64) * size + r[:, 1], r[:, 2:]]) for r, _ in held])
            count = np.concatenate([count for _, count in held])
            held.clear()
            if kind == 1:
                np.add.at(totals, bucket[:, 0] // size, count)
            for d, found, often in frequent(bucket, count, tuple(x - 1 for x in depths), least):
                if len(found):
                    leading = [found[:, 0] % size, *(found[:, c] for c in range(1, d + 1))]
                    parts = [dictionary.take(pa.array(c)).to_pylist() for c in leading]
                    text = [b" ".join(p).decode("utf-8", "surrogatepass") for p in zip(*parts)]
                    yield _phrases(names[found[:, 0] // size], text, d + 1, often)
    there = np.flatnonzero(totals)
    yield _phrases(names[there], [""] * len(there), 0, totals[there])


def _phrases(lang: np.ndarray, text: list[str], size: int, often: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(lang), pa.string()), pa.array(text, pa.string()), pa.array(np.full(len(text), size, np.int32)), pa.array(often.astype(np.int64))],
        ["lang", "phrase", "size", "f"],
    )


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, phrase, size, f)``: every phrase of up to four words that occurs often enough.

    Rows of size 0, one or more a language, add up to the number of its words.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-amount // PART_BYTES))
    dealt = rows.mapInArrow(lambda it: _deal(it, parts), "part int, languages array<string>, blob binary")
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(
        lambda it: _count(it, least), "lang string, phrase string, size int, f long"
    )


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of each language that hold together best."""
    counted = written(phrase_counts(docs, least, text, lang))
    totals = counted.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    part = counted.filter("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    phrases = counted.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    longer = phrases.filter("size > 2").select(
        "lang", F.col("a").alias("f"),
        F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), k -> "
            "transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))"
        )).alias("phrase"),
    )
    # Partial maxima before the shuffle: a phrase within very many others is one row a task.
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    hundred = lambda c, times: F.col(c).cast("decimal(20,0)") * F.lit(times).cast("decimal(10,0)")
    alone = phrases.join(most, ["lang", "phrase"], "left").filter(
        F.col("f").isNull() | (hundred("f", 100) < hundred("a", inside))
    ).select("lang", "phrase", "a", "size", "words")
    cuts = alone.select("lang", "phrase", "a", "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"),
    )
    cut = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    lowest = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = scored
    # The best of groups of phrases first: what meets in one task then does not grow with the phrases.
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
