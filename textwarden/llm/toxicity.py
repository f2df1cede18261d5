"""Toxicity of texts that hide their words: a noisy channel, then a classifier.

Writers hide a word by look-alike signs (``1d10t``), by gaps between its letters, or by
repeating them.  Each such stretch of a text becomes a lattice of what its signs may stand
for; Viterbi decoding under a character trigram model picks the likeliest reading, once as
one word, and once with gaps that may also be edges of words, so that it cuts the stretch.  The
trigram model is counted over the whole corpus.  Plain words have a one-path lattice, so
they are taken as they are.  A logistic model then scores the restored text by the rates
of the words, and of beginnings of words, that stand out among labelled texts.

The classifier is fitted on at most ``LABELLED_ROWS`` labelled rows, chosen by a hash of
the id, and has at most ``FEATURES`` features: of all that occur in some toxic texts among
those rows, the ones whose rates differ most between the labels.  Everything else covers all
rows and whole texts.

Defined results: null and empty texts are scored like texts without any known word; with
no labelled rows every score is about 0, and with one label only about that label; repeated rows get equal scores; labels that contradict
each other count as toxic; empty tables give empty tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import textnum
from textwarden.operators.staging import stage

LABELLED_ROWS = 20_000
#: Features of the classifier.
FEATURES = 512
#: 64-bit words of a bitmap over the features whose rates are summed up.
BITMAP_WORDS = 1 << 17
#: Rows of a block of the matrix the classifier is fitted on.
FIT_ROWS = 2048
#: A feature occurs in that many toxic texts, and its mean rates are that many deviations apart.
LEAST_TEXTS, LEAST_Z = 4, 2.5
#: A word counts as a whole and by its beginnings of these lengths.
BEGINNINGS = range(3, 9)
#: A text counts as having that many words at least, when rates are taken.
LEAST_WORDS = 20
RIDGE = 0.1
#: Texts with this score or more are predicted toxic.
TOXIC = 0.5
#: Letters a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
#: What may stand between the letters of a word that is spread out: signs that are no words, and blanks.
_GAP = r"(?:[^\w" + re.escape("".join(c for c in LOOKALIKES if not c.isdigit())) + "]|_)+"
#: Logarithms of the channel: a letter hidden by a sign, a run kept as two letters, as one, a sign dropped, a pair as one.
HIDDEN, AS_TWO, AS_ONE, DROPPED, HALVED = -0.7, -1.5, -0.3, -4.0, -2.5
#: The edge of a word as a reading: the sign before "a", so that it is symbol 0.
EDGE = "`"
#: Results kept by a task; they are dropped together when there are more.
MEMO = 50_000
_SYMBOLS = 27  # 0 is the edge of a word, 1 to 26 are the letters


@lru_cache
def _symbols() -> np.ndarray:
    """The symbol of each code point: its letter a to z without accents, else 0."""
    table = np.zeros(0x3000, np.uint8)
    for i in range(len(table)):
        base = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        table[i] = ord(base) - 96 if "a" <= base <= "z" else 0
    return table


def symbols(code: np.ndarray) -> np.ndarray:
    table = _symbols()
    return np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 0)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in textnum.blocks(batches):
        s = symbols(textnum.codes(textnum.texts(batch))[0]).astype(np.int64)
        s = np.concatenate([[0, 0], s, [0]])
        total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_model(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, counted over all rows."""
    counts = rows.select(F.col(text).alias("text")).mapInArrow(_trigrams, "gram int, n long")
    n = np.zeros(_SYMBOLS**3)
    for row in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 27 ** 3 rows
        n[row.gram] = row.n
    n = n.reshape((_SYMBOLS,) * 3) + 0.1
    n[0, 0, 0] = 0.1  # runs of other signs say nothing about words
    return np.log(n / n.sum(axis=2, keepdims=True))


#: A lattice: for every sign, or run of one, the readings (letters, cost).
Lattice = list[list[tuple[str, float]]]


def lattice(stretch: str, edges: bool = False) -> Lattice:
    """What the signs of a stretch of lower-case text may stand for; with ``edges``, a gap may be one."""
    out: Lattice = []
    for run in re.finditer(rf"{_GAP}|(.)\1*", stretch, re.DOTALL):
        sign, n = run[1], len(run[0])
        if sign is None:
            out.append([("", 0.0), (EDGE, 0.0)] if edges else [("", 0.0)])
            continue
        plain = unicodedata.normalize("NFKD", sign)[:1]
        if "a" <= plain <= "z":
            if n >= 3:
                out.append([(plain, AS_ONE), (plain * 2, AS_TWO)])
            else:
                out.append([(plain * n, 0.0)] + [(plain, HALVED)] * (n == 2))
            continue
        readings = [("", DROPPED)]
        for letter in LOOKALIKES.get(sign, ""):
            if n <= 2:
                readings.append((letter * n, HIDDEN * n))
                readings += [(letter, HIDDEN + HALVED)] * (n == 2)
            else:
                readings += [(letter, HIDDEN + AS_ONE), (letter * 2, HIDDEN + AS_TWO)]
        out.append(readings)
    return out


def decode(stretch: str, model: np.ndarray, edges: bool = False) -> str:
    """The likeliest letters of a stretch: Viterbi over pairs of symbols; with ``edges``, words between blanks."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    log_p = model
    for readings in lattice(stretch, edges):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, cost in readings:
                x, y, total = a, b, score + cost
                for letter in letters:
                    z = ord(letter) - 96
                    total += log_p[x, y, z]
                    x, y = y, z
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, text + letters if len(stretch) < 1000 else (text, letters))
        states = after
    best = max(states.items(), key=lambda s: s[1][0] + log_p[s[0][0], s[0][1], 0])[1][1]
    parts = []
    while isinstance(best, tuple):  # long stretches are kept as links, which costs no copies
        parts.append(best[1])
        best = best[0]
    best += "".join(reversed(parts))
    return " ".join(best.replace(EDGE, " ").split()) if edges else best


@lru_cache
def _signs() -> np.ndarray:
    out = np.zeros(textnum._UNITS, bool)
    out[[ord(c) for c in LOOKALIKES]] = True
    return out


#: Code points from here on are no gaps.
_FAR = 0x20000


@lru_cache
def _gaps() -> np.ndarray:
    """Which code points may stand between two letters: blanks, controls, punctuation and symbols."""
    out = np.fromiter((unicodedata.category(chr(i))[0] in "ZPS" or unicodedata.category(chr(i)) in ("Cc", "Cf") for i in range(_FAR + 1)), bool)
    out[_FAR] = False
    return out


def odd_stretches(code: np.ndarray, ends: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges of lower-case code points that may hide a word.

    A token that mixes letters with look-alikes, repeats a letter three times or doubles
    all its letters; and runs of three or more single signs with a gap between each.  ``ends``: where rows start, which
    no gap bridges.
    """
    letter, sign = textnum.letters()[code], _signs()[code]
    space = (code <= 32) | (code == 0xA0)
    begin, end = textnum.runs(~space)
    core = np.zeros(len(code), bool)
    core[:-1] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    core[:-2] |= letter[:-2] & (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:])
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[:-1] == code[1:]
    same = same[1:] | same[:-1]  # like a neighbour
    once, twice = (np.concatenate([[0], np.cumsum(x)]) for x in (letter & ~same, letter & same))
    core[begin[(once[end] == once[begin]) & (twice[end] - twice[begin] >= 4)]] = True
    at = np.flatnonzero(core)
    token = np.unique(np.searchsorted(begin, at, side="right") - 1)
    out = [(int(begin[t]), int(end[t])) for t in token]
    reads = letter | sign
    single = reads.copy()
    single[1:] &= ~reads[:-1]
    single[:-1] &= ~reads[1:]
    # Between two reads that follow each other there are other signs only; marks and rows' ends are no gaps.
    other = np.concatenate([[0], np.cumsum(~reads & ~_gaps()[np.minimum(code, _FAR)])])
    nth = np.cumsum(reads)
    place = np.flatnonzero(single)
    if len(place) > 2:
        linked = (np.diff(nth[place]) == 1) & (other[place[1:]] == other[place[:-1]])
        if ends is not None:
            linked &= np.diff(np.searchsorted(ends, place, side="right")) == 0
        a, b = textnum.runs(linked)
        for i, j in zip(a, b):
            if j - i >= 2 and letter[place[i : j + 1]].any():
                out.append((int(place[i]), int(place[j]) + 1))
    return sorted(out)


_DECORATION = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_DOUBLED = re.compile(r"(?:(.)\1)+", re.DOTALL)
_WORDS = re.compile(r"[^\W\d_]+")


class Reader:
    """Decodes stretches; keeps what it has decoded."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.memo = model, {}

    def words(self, stretch: str) -> list[str]:
        found = self.memo.get(stretch)
        if found is None:
            plain = _DECORATION.sub("", stretch)
            if _WORDS.fullmatch(plain) and not re.search(r"(.)\1\1", plain) and not _DOUBLED.fullmatch(plain):
                found = _WORDS.findall(plain)
            else:
                whole, cut = decode(plain, self.model), decode(plain, self.model, edges=True).split()
                found = [w for w in (whole, *(cut if cut != [whole] else ()), *_pieces(plain, self.model)) if w]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[stretch] = found
        return found


def _pieces(stretch: str, model: np.ndarray) -> list[str]:
    """Readings of the parts of a stretch that plain punctuation splits."""
    parts = [p for p in re.split(r"[^\w@$!|+(€£*#]+", stretch) if p]
    return [decode(p.strip("!+(*#|"), model) for p in parts if len(parts) > 1 or p.strip("!+(*#|") != stretch]


def restored_words(rows: list[str], reader: Reader) -> tuple[list[str], list[int]]:
    """The words that were hidden, and the row of each."""
    code, starts = textnum.codes([t.lower() for t in rows])
    flat, words, row = code.tobytes(), [], []
    for a, b in odd_stretches(code, starts):
        found = reader.words(flat[4 * a : 4 * b].decode("utf-32-le", "surrogatepass"))
        words += found
        row += [int(np.searchsorted(starts, a, side="right")) - 1] * len(found)
    return words, row


def _features_of(code: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, feature)`` of words that stand at ``[begin, end)``: the word itself and its beginnings."""
    prefix = textnum.prefix_hash(code)
    yield row, textnum.mixed(textnum.range_hash(prefix, begin, end))
    for n in BEGINNINGS:
        longer = end - begin > n
        yield row[longer], textnum.range_hash(prefix, begin[longer], begin[longer] + n)


class Counted(NamedTuple):
    """Rates of wanted features in a block of rows: row, place of the feature, value."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray


def _block_features(rows: list[str], reader: Reader) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """All features of the rows, restored words included, and how many words a row has."""
    code, starts = textnum.codes([t.lower() for t in rows])
    begin, end = textnum.runs(textnum.letters()[code])
    row = np.searchsorted(starts, begin, side="right") - 1
    words, of = restored_words(rows, reader)
    hidden, at = textnum.codes(words)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _features_of(code, begin, end, row)
        if words:
            yield from _features_of(hidden, at[:-1], at[1:] - 1, np.array(of, np.int64))

    return each(), np.bincount(row, minlength=len(rows))


def _rate(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How dense a feature is that occurs so often among so many words, on a log scale."""
    return np.log1p(100.0 * n / np.maximum(words, LEAST_WORDS))


def rates(rows: list[str], reader: Reader, wanted: np.ndarray) -> Counted:
    """How dense the wanted features, in ascending order, are in every row, on a log scale."""
    features, words = _block_features(rows, reader)
    hits = []
    for row, feature in features:
        if not len(wanted):
            break
        at = np.minimum(np.searchsorted(wanted, feature), len(wanted) - 1)
        hit = wanted[at] == feature
        hits.append(row[hit] * len(wanted) + at[hit])
    cell, n = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
    row, place = np.divmod(cell, max(1, len(wanted)))
    return Counted(row, place, _rate(n, words[row]))


def restore(text: str, model: np.ndarray) -> str:
    """The text in lower case, its hidden words restored."""
    code, _ = textnum.codes([(text or "").lower()])
    flat, at, out = code.tobytes(), 0, []
    cut = lambda a, b: flat[4 * a : 4 * b].decode("utf-32-le", "surrogatepass")
    for a, b in odd_stretches(code):
        if a >= at:
            out += [cut(at, a), decode(_DECORATION.sub("", cut(a, b)), model, edges=True)]
            at = b
    return ("".join(out) + cut(at, len(code)))[:-1]


class Model(NamedTuple):
    characters: np.ndarray
    features: np.ndarray  # ascending
    weights: np.ndarray
    bias: float


def _toxic_features(batches: Iterator[pa.RecordBatch], characters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In how many rows each feature occurs."""
    reader, seen = Reader(characters), []
    for batch in textnum.blocks(batches):
        features, _ = _block_features(textnum.texts(batch), reader)
        row, feature = map(np.concatenate, zip(*features))
        seen.append(np.unique(np.stack([row.astype(np.uint64), feature]), axis=1)[1])
    found, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["feature", "n"])


def _bitmap(found: DataFrame) -> np.ndarray:
    """A bit for every feature, at a place its hash names: of one size for any number of features."""
    word = F.pmod("feature", F.lit(BITMAP_WORDS)).cast("int").alias("word")
    bit = F.shiftrightunsigned("feature", BITMAP_WORDS.bit_length() - 1).bitwiseAND(63).cast("int")
    rows = found.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _marked(feature: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    word = bitmap[(feature % np.uint64(len(bitmap))).astype(np.int64)]
    place = feature >> np.uint64(len(bitmap).bit_length() - 1) & np.uint64(63)
    return (word >> place & np.uint64(1)).astype(bool)


def _moments(batches: Iterator[pa.RecordBatch], characters: np.ndarray, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and sums of squares of the marked features' rates, by label, for every block."""
    reader = Reader(characters)
    for batch in textnum.blocks(batches):
        features, words = _block_features(textnum.texts(batch), reader)
        kept = [(row[m], f[m]) for row, f in features for m in (_marked(f, bitmap),)]
        row, feature = map(np.concatenate, zip(*kept))
        feature, place = np.unique(feature, return_inverse=True)
        cell, n = np.unique(row * max(1, len(feature)) + place, return_counts=True)
        row, place = np.divmod(cell, max(1, len(feature)))
        value = _rate(n, words[row])
        toxic = batch.column("label").to_numpy()[row] == 1
        sums = [np.bincount(place[own], v[own], minlength=len(feature)) for v in (value, value**2) for own in (~toxic, toxic)]
        yield pa.RecordBatch.from_arrays(
            # Sums over no row at all come as whole numbers.
            [pa.array(feature.view(np.int64)), *(pa.array(s, pa.float64()) for s in sums)], ["feature", "x0", "x1", "y0", "y1"]
        )


def _standing_out(sums: DataFrame, n: np.ndarray) -> DataFrame:
    """The features whose mean rates differ most between the labels, in deviations, and by how many."""
    mean = [F.col(f"x{j}") / float(n[j]) for j in (0, 1)]
    spread = [F.greatest(F.col(f"y{j}") / float(n[j]) - mean[j] * mean[j], F.lit(0.0)) / float(n[j]) for j in (0, 1)]
    z = F.abs(mean[1] - mean[0]) / F.sqrt(spread[0] + spread[1] + F.lit(0.25 / float(n.prod())))
    return sums.select("feature", z.alias("z")).filter(F.col("z") >= LEAST_Z)


def _sample_rates(batches: Iterator[pa.RecordBatch], characters: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    reader = Reader(characters)
    for batch in textnum.blocks(batches):
        found = rates(textnum.texts(batch), reader, wanted)
        cuts = np.searchsorted(found.row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(cuts, pa.array(found.place.astype(np.int32))),
             pa.ListArray.from_arrays(cuts, pa.array(found.value))],
            ["label", "place", "value"],
        )


def _fit(label: np.ndarray, start: np.ndarray, place: np.ndarray, value: np.ndarray, size: int, ridge: float = RIDGE) -> np.ndarray:
    """Logistic weights by Newton steps; the last is the bias, which is not held back.

    A row's features are ``place[start[i]:start[i + 1]]``.  The matrix is laid out a block
    at a time.
    """
    w, hold = np.zeros(size + 1), np.full(size + 1, ridge)
    hold[-1] = 1e-3
    for _ in range(25):
        gradient, bend = hold * w, np.diag(hold)
        for a in range(0, len(label), FIT_ROWS):
            b = min(a + FIT_ROWS, len(label))
            x = np.zeros((b - a, size + 1))
            x[:, -1] = 1
            x[np.repeat(np.arange(b - a), np.diff(start[a : b + 1])), place[start[a] : start[b]]] = value[start[a] : start[b]]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (p - label[a:b])
            bend += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(bend, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> Model:
    """Characters from all documents, words and weights from the labelled ones.

    ``labels`` has ``(key, toxic)``, only rows that may be learned from.
    """
    characters = character_model(docs, text)
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(characters)
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows)
    sample = stage(docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).select("label", "text"))
    n = np.array(sample.agg(F.sum(F.expr("if(label = 1, 0, 1)")), F.sum(F.expr("if(label = 1, 1, 0)"))).first(), float)
    if not n.all() or np.isnan(n).any():  # nothing to tell apart
        return Model(characters, np.zeros(0, np.uint64), np.zeros(0), 30.0 if n[1] > 0 else -30.0)
    found = sample.filter("label = 1").mapInArrow(lambda it: _toxic_features(it, kept.value), "feature long, n long")
    found = found.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    found = stage(found.select("feature"))
    marks = spark.sparkContext.broadcast(_bitmap(found))
    sums = sample.mapInArrow(
        lambda it: _moments(it, kept.value, marks.value), "feature long, x0 double, x1 double, y0 double, y1 double"
    ).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("x0", "x1", "y0", "y1")))
    # Features that only share their place in the bitmap with another one drop out here.
    best = _standing_out(sums.join(found, "feature", "left_semi"), n).orderBy(F.col("z").desc(), "feature").limit(FEATURES)
    wanted = np.sort(best.select("feature").toArrow().column("feature").to_numpy().view(np.uint64))
    # LABELLED_ROWS rows of at most FEATURES numbers, as arrays.
    data = sample.mapInArrow(
        lambda it: _sample_rates(it, kept.value, wanted), "label int, place array<int>, value array<double>"
    ).toArrow()
    place, value = (data.column(c).combine_chunks() for c in ("place", "value"))
    w = _fit(
        data.column("label").to_numpy().astype(float), place.offsets.to_numpy().astype(np.int64) - place.offsets[0].as_py(),
        place.flatten().to_numpy(), value.flatten().to_numpy(), len(wanted),
    )
    for sent in (kept, marks):
        sent.destroy()
    return Model(characters, wanted, w[:-1], float(w[-1]))


def _scores(rows: list[str], reader: Reader, model: Model) -> np.ndarray:
    found = rates(rows, reader, model.features)
    logit = model.bias + np.bincount(found.row, model.weights[found.place] * found.value, minlength=len(rows))
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader = Reader(model.characters)
    for batch in textnum.blocks(batches):
        score = _scores(textnum.texts(batch), reader, model)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score)], ["key", "score"])


def _clean(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    reader = Reader(model.characters)
    for batch in textnum.blocks(batches, text):
        yield batch.filter(pa.array(_scores(textnum.texts(batch, text), reader, model) < TOXIC))


def score(docs: DataFrame, model: Model, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, predicted)``, one row per document."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(it, kept.value), f"key {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; nothing is shuffled."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _clean(it, kept.value, text), docs.schema)
