"""Importance resampling: which raw texts look like the target texts.

Words and word pairs are hashed into buckets; one model of the buckets is counted over
the target texts, one over all raw texts.  A document's log weight is the sum of the log
ratios of its buckets.  Gumbel noise drawn from its id is added, and the highest share of
the documents is taken: a sample without replacement by weight.  The threshold is found
by counting, in rounds of a fixed number of intervals, so no list of keys is gathered.

Defined results: null and empty texts have log weight 0; rows with one id share the noise,
and rows that tie with the threshold are all taken; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm import textnum
from textwarden.operators.staging import stage

BUCKETS = 10_000
SMOOTH = 1.0
#: Labelled rows that the target model is fitted on, at most.
TARGET_ROWS = 20_000
#: Share of the documents that is taken, and intervals of a counting round.
SHARE, INTERVALS = 0.5, 4096


def gram_buckets(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the row of each."""
    code, starts = textnum.codes([t.lower() for t in rows])
    space = (code <= 32) | (code == 0x85) | (code == 0xA0)
    begin, end = textnum.runs(~space)
    word = textnum.range_hash(textnum.prefix_hash(code), begin, end)
    row = np.searchsorted(starts, begin, side="right") - 1
    pair = textnum.mixed(word[:-1] * np.uint64(3) + word[1:])
    inside = row[:-1] == row[1:]
    grams = np.concatenate([word, pair[inside]])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[:-1][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in textnum.blocks(batches):
        total += np.bincount(gram_buckets(textnum.texts(batch))[0], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])


def log_model(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of the buckets over all rows."""
    counts = rows.select(F.col(text).alias("text")).mapInArrow(_count, "n array<long>")
    cells = counts.select(F.posexplode("n").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros(BUCKETS)
    for row in cells.collect():  # at most BUCKETS rows
        n[row.bucket] = row.n
    return np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in textnum.blocks(batches):
        bucket, row = gram_buckets(textnum.texts(batch))
        weight = np.bincount(row, ratio[bucket], minlength=batch.num_rows).astype(np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(weight)], ["key", "log_weight"])


def log_weights(raw: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, log_weight)`` of every raw row."""
    ratio = log_model(target, text) - log_model(raw, text)
    kept = raw.sparkSession.sparkContext.broadcast(ratio)
    rows = raw.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _weigh(it, kept.value), f"key {kind}, log_weight double")


def nth_highest(rows: DataFrame, column: str, n: int) -> float | None:
    """The n-th highest value, found by counting intervals; None if there are fewer rows."""
    low, high, count = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < 1 or count < n:
        return None
    while low < high:
        width = (high - low) / INTERVALS
        cell = F.least(F.floor((F.col(column) - low) / width) if width > 0 else F.lit(0), F.lit(INTERVALS - 1))
        inside = rows.filter(F.col(column).between(low, high))
        found = inside.groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()  # at most INTERVALS rows
        for part in sorted(found, key=lambda r: -r.cell):
            if part.n >= n:
                break
            n -= part.n
        if n == 1:
            return part.high
        if (part.low, part.high) == (low, high):  # too narrow to cut: the smallest that is left decides
            values = inside.groupBy(column).count().orderBy(F.col(column).desc()).limit(n).collect()
            for value, times in values:
                if times >= n:
                    return value
                n -= times
        low, high = part.low, part.high
    return low


def target_rows(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS, key: str = "doc_id") -> DataFrame:
    """Documents labelled as good, a bounded choice by a hash of the id."""
    good = labels.filter("quality = 1").select(F.col(key)).distinct()
    chosen = good.orderBy(F.xxhash64(key), key).limit(rows)
    return docs.join(F.broadcast(chosen), key, "left_semi")


def resample(
    raw: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 0, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(key, log_weight, gumbel_key, selected)``, one row per document."""
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = stage(log_weights(raw, target, key, text).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    least = nth_highest(keyed, "gumbel_key", int(np.ceil(share * keyed.count())))
    chosen = F.lit(False) if least is None else F.col("gumbel_key") >= least
    return keyed.select(F.col("key").alias(key), "log_weight", "gumbel_key", chosen.alias("selected"))
