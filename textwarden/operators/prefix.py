"""Running values over long ordered groups, without one task per group.

A window over a whole group sorts that group in one task, however many rows it holds.
Here all rows are cut into ranges of the group and the order column, with about equally
many rows whatever the numbers are and however they are spread over groups.  Rows are
windowed within their chunk; one summary row per chunk and group is windowed over the
group and hands each chunk what came before it.  A group holding a third of all rows is
spread over a third of the chunks; small groups share one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.operators.staging import stage

#: Rows of a chunk, about.
DEFAULT_WIDTH = 100_000


def chunked(df: DataFrame, keys: Sequence[str], order: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The rows with their ``_chunk``: numbers that rise with the keys and the order column.

    The rows are written once, so a chunk stays what it is if a task is run again.  They
    are read three times before (to count, to find the ranges, to deal them out), so hand
    in rows that are staged or cheap.
    """
    parts = max(1, -(-df.count() // int(width)))
    return stage(df.repartitionByRange(parts, *keys, order).withColumn("_chunk", F.spark_partition_id()))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str] | None = None,
    lows: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Adds, for every row, values over the rows before it in its group.

    ``sums`` are cumulative sums of SQL expressions, ``lows`` the lowest inclusive
    cumulative sum so far (null on the first row), ``lasts`` the last value that is not
    null.  ``order`` is unique within the group; a chunk holds about ``width`` rows.
    """
    sums, lows, lasts = dict(sums or {}), dict(lows or {}), dict(lasts or {})
    keys = list(keys)
    part = [*keys, "_chunk"]
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = chunked(df, keys, order, width)

    # Within the chunk.
    local = cut.select(
        "*",
        *[F.coalesce(F.sum(F.expr(e)).over(before), F.lit(0)).alias(f"_sum_{n}") for n, e in sums.items()],
        *[F.sum(F.expr(e)).over(upto).alias(f"_run_{n}") for n, e in lows.items()],
        *[F.last(F.expr(e), True).over(before).alias(f"_last_{n}") for n, e in lasts.items()],
    ).select("*", *[F.min(f"_run_{n}").over(before).alias(f"_low_{n}") for n in lows])

    # One row per chunk.  Without lows nothing here needs an order, so rows are
    # combined before they are shuffled.
    source = local if lows else cut
    summary = source.groupBy(*part).agg(
        *[F.sum(F.expr(e)).alias(f"_total_{n}") for n, e in {**sums, **lows}.items()],
        *[F.min(f"_run_{n}").alias(f"_floor_{n}") for n in lows],
        *[
            F.max_by(F.expr(e), F.when(F.expr(e).isNotNull(), F.col(order))).alias(f"_tail_{n}")
            for n, e in lasts.items()
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *part,
        *[
            F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}")
            for n in {**sums, **lows}
        ],
        *[F.col(f"_floor_{n}") for n in lows],
        *[F.last(f"_tail_{n}", True).over(earlier).alias(f"_carry_{n}") for n in lasts],
    )
    carried = carried.select(
        "*",
        *[
            F.min(F.col(f"_base_{n}") + F.col(f"_floor_{n}")).over(earlier).alias(f"_past_{n}")
            for n in lows
        ],
    ).drop(*[f"_floor_{n}" for n in lows])

    joined = local.join(carried, part)
    return joined.select(
        *df.columns,
        *[(F.col(f"_base_{n}") + F.col(f"_sum_{n}")).alias(n) for n in sums],
        *[
            F.least(F.col(f"_past_{n}"), F.col(f"_base_{n}") + F.col(f"_low_{n}")).alias(n)
            for n in lows
        ],
        *[F.coalesce(f"_last_{n}", f"_carry_{n}").alias(n) for n in lasts],
    )
