"""Exact top-k search: tiled products of query blocks and vector shards.

Vectors become whole numbers, are dealt into shards and packed there into blocks of
consecutive rows.  Every block of queries is sent to every shard once; a task then holds
one tile at a time, multiplies it as a matrix and keeps the best k of each query in the
tile.  The lists are merged as a tree: first among groups of shards, then at the top.

Defined results: a vector that is null, or holds a null or a component that is not
finite, or has no id, takes no part.  Of rows that share an id the one with the smallest
vector counts.  A shorter vector is filled up with zeros.  Products are exact: as floating
point while every sum stays below 2**53, as integers beyond; a score outside 64 bits is
held at their limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textwarden.operators.staging import stage

#: Vectors of a shard and of a query block.
SHARD_ROWS = 1024
BLOCK_ROWS = 256
#: Lists merged at once on the lower level of the tree.
FAN_IN = 32
_TILE = "query_id long, shard long, vec_id long, score long"
_INT = np.int64


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``(id, v)``: one usable vector for each id, its components as floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(key).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    clean = rows.filter(usable).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    wide = F.transform(F.col("v").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    return clean.select("id", wide.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), _INT)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, id, v)``, those of a shard together, as blocks of at most ``rows``."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(shard)]):
            for i in range(a, b, rows):
                part = batch.slice(i, min(rows, b - i))
                m = _matrix(part.column("v"))
                m = m.astype(np.result_type(np.min_scalar_type(m.min(initial=-1)), np.min_scalar_type(m.max(initial=0) * -1 - 1)))
                out.append((int(shard[a]), part.column("id").to_numpy().tobytes(), m.dtype.str, m.tobytes()))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())],
                ["shard", "ids", "kind", "data"],
            )


def _packed(rows: DataFrame, shards: int, size: int) -> DataFrame:
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")
    return dealt.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(
        lambda it: _pack(it, size), "shard long, ids binary, kind string, data binary"
    )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of whole numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    # As Python numbers: the magnitudes' product may pass 64 bits.
    most = max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) * max(
        abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))
    ) * width
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(_INT)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(_INT)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; ids ascend."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        s = scores[places]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, level = places[s > least], places[s == least]
        places = np.concatenate([above, level[: k - len(above)]])
    return places


def _rows(data: bytes, kind: str, n: int) -> np.ndarray:
    flat = np.frombuffer(data, kind)
    return flat.reshape(n, len(flat) // n).astype(_INT)


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q_ids, q_kind, q_data, ids, kind, data, shard in zip(
            *(batch.column(c).to_pylist() for c in ("q_ids", "q_kind", "q_data", "ids", "kind", "data", "shard"))
        ):
            q_id, id_ = np.frombuffer(q_ids, _INT), np.frombuffer(ids, _INT)
            score = products(
                _rows(q_data, q_kind, len(q_id)), _rows(data, kind, len(id_))
            )
            best = [best_of(score[i], id_, own, k) for i, own in enumerate(q_id)]
            n = [len(b) for b in best]
            at = np.concatenate(best) if best else np.zeros(0, _INT)
            row = np.repeat(np.arange(len(q_id)), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_id[row]), pa.array(np.full(len(at), shard, _INT)), pa.array(id_[at]), pa.array(score[row, at])],
                ["query_id", "shard", "vec_id", "score"],
            )


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    rows: DataFrame, is_query: Callable[[Column], Column], k: int = 20, key: str = "vec_id",
    vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of every query.

    ``is_query`` tells from an id whether its row is a query.
    """
    vectors = stage(whole_vectors(rows, key, vector, scale))
    shards = max(1, -(-vectors.count() // shard_rows))
    shard = stage(_packed(vectors, shards, shard_rows))
    queries = vectors.filter(is_query(F.col("id")))
    blocks = max(1, -(-queries.count() // block_rows))
    query = _packed(queries, blocks, block_rows).select(
        F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data")
    )
    sent = query.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    tiles = sent.join(shard, "shard").mapInArrow(lambda it: _tiles(it, k), _TILE)
    tiles = tiles.withColumn("branch", F.expr(f"shard div {FAN_IN}"))
    lower = _best(tiles, k, "query_id", "branch").drop("rank")
    return _best(lower, k, "query_id").select("query_id", "rank", "vec_id", "score")
