"""Language mixtures of documents, by expectation maximisation.

Every language gets a model of hashed character trigrams, counted over all rows that may
be learned from.  A word's likelihood in a language is the product of its trigrams'.  A
document is a mixture: each word comes from one language, drawn by the document's
proportions, which expectation maximisation estimates.  How many languages it has is
decided by penalised likelihood over the sets of its most likely languages.

The model has one row of ``BUCKETS`` numbers per language and is sent to every task;
more than ``MAX_LANGUAGES`` languages are refused.

Defined results: null text and text without a letter is ``und`` with score 0, and so is
every text if there is nothing to learn from; ties go to the first language in order;
repeated rows get equal answers; empty tables give empty tables.  Memory in a task grows
with the longest text, never with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import textnum

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
#: Added to every count.
SMOOTH = 0.5
#: Rounds of estimation, and the price of a further language in halves of log(words).
ROUNDS, PRICE = 12, 2.0
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def word_grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram bucket of each letter, each word's first letter's place, each row's first word."""
    code, starts = textnum.codes([t.lower() for t in rows])
    is_letter = textnum.letters()[code]
    c = np.where(is_letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    before, after = np.where(at > 0, c[at - 1], 0), c[np.minimum(at + 1, len(c) - 1)]
    gram = textnum.mixed((before.astype(np.uint64) << np.uint64(42)) | (c[at] << np.uint64(21)) | after)
    bucket = (gram % np.uint64(BUCKETS)).astype(np.int64)
    begin, _ = textnum.runs(is_letter)
    return bucket, np.searchsorted(at, begin), np.searchsorted(begin, starts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in textnum.blocks(batches):
        bucket, words, first = word_grams(textnum.texts(batch))
        ends = np.append(words, len(bucket))[first]
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            own = bucket[ends[i] : ends[i + 1]]
            if len(own) > BUCKETS // 8:
                total[lang] += np.bincount(own, minlength=BUCKETS)
            else:
                np.add.at(total[lang], own, 1)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
            ["lang", "bucket", "n"],
        )


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """The models of all languages, counted over every row that has one."""
    known = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    found = sorted(per_lang.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    log_p = np.zeros((BUCKETS, len(found)), np.float32)
    for k, row in enumerate(found):
        n = np.zeros(BUCKETS)
        n[[c.bucket for c in row.cells]] = [c.n for c in row.cells]
        log_p[:, k] = np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))
    return Model([row.lang for row in found], log_p)


def _estimate(p: np.ndarray, count: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihoods of the rows; ``p``: words x languages, scaled by word."""
    for step in range(ROUNDS + 1):
        joint = p * np.repeat(share, count, axis=0)
        total = joint.sum(axis=1, keepdims=True)
        if step == ROUNDS:
            break
        joint /= np.maximum(total, 1e-30)
        share = np.add.reduceat(joint, start, axis=0) / count[:, None]
    return share, np.add.reduceat(np.log(np.maximum(total[:, 0], 1e-30)).astype(np.float64), start)


def mixtures(log_p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each row's proportions; ``log_p``: the words' likelihoods, ``count``: words per row, none 0."""
    rows, k = len(count), log_p.shape[1]
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    alone = np.add.reduceat((log_p - top).astype(np.float64), start, axis=0)
    best = np.zeros((rows, k))
    best[np.arange(rows), alone.argmax(axis=1)] = 1.0
    if k == 1:
        return best
    value = alone.max(axis=1)
    price = PRICE * 0.5 * np.log(count + 1.0)
    share, full = _estimate(p, count, start, np.full((rows, k), 1 / k, np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, k + 1):
        # No set can be likelier than all languages together.
        open_ = np.flatnonzero(full - (size - 1) * price > value)
        if not len(open_):
            break
        chosen = np.zeros((len(open_), k), bool)
        np.put_along_axis(chosen, order[open_, :size], True, axis=1)
        own = np.where(chosen, np.maximum(share[open_], 1e-6), 0).astype(np.float32)
        own /= own.sum(axis=1, keepdims=True)
        words = np.repeat(start[open_] - np.concatenate([[0], np.cumsum(count[open_])[:-1]]), count[open_])
        words += np.arange(len(words))
        first = np.concatenate([[0], np.cumsum(count[open_])[:-1]])
        now, likelihood = _estimate(p[words], count[open_], first, own)
        better = likelihood - (size - 1) * price[open_] > value[open_]
        value[open_[better]] = (likelihood - (size - 1) * price[open_])[better]
        best[open_[better]] = now[better]
    return best


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = model.languages
    for batch in textnum.blocks(batches):
        bucket, words, first = word_grams(textnum.texts(batch))
        count = np.diff(first)
        share = np.zeros((batch.num_rows, max(1, len(names))))
        told = np.flatnonzero(count > 0) if names else np.zeros(0, np.int64)
        if len(told):
            word_p = np.concatenate([
                np.add.reduceat(model.log_p[bucket[a:b]], words[i:j] - a, axis=0)
                for i, j, a, b in _pieces(words, len(bucket))
            ])
            share[told] = mixtures(word_p, count[told])
        best = share.argmax(axis=1)
        has = share.max(axis=1) > 0
        mixture = [
            [{"lang": names[k], "share": float(share[i, k])} for k in np.argsort(-share[i], kind="stable") if share[i, k] > 0]
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array([names[k] if h else UNKNOWN for k, h in zip(best, has)], pa.string()),
                pa.array(np.clip(share.max(axis=1), 0, 1)),
                pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
            ],
            ["key", "lang_pred", "score", "mixture"],
        )


def _pieces(words: np.ndarray, grams: int, limit: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """Word and trigram ranges of bounded size."""
    for i in range(0, len(words), limit):
        j = min(i + limit, len(words))
        yield i, j, int(words[i]), int(words[j]) if j < len(words) else grams


def predict(docs: DataFrame, model: Model, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, mixture)``: the main language, its share, and all shares."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        lambda it: _predict(it, kept.value),
        f"key {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>",
    )
