"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of links ``(a, b)``: the smallest node it reaches.

    Every round a node takes the smallest of its label, its neighbours' labels and its
    label's label, so long chains shorten by half.  A node with very many links is summed
    up map-side, and its join is left to adaptive execution to split.  Rounds are written
    to the shared folder, so lineage stays short.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        known = labels.select(F.col("node").alias("of"), F.col("label").alias("found"))
        own = labels.select("node", F.col("label").alias("found"), F.col("label").alias("old"))
        near = both.join(known, both["b"] == known["of"]).select(F.col("a").alias("node"), "found", F.lit(None).alias("old"))
        jump = labels.join(known, labels["label"] == known["of"]).select("node", "found", F.lit(None).alias("old"))
        after = written(own.union(near).union(jump).groupBy("node").agg(F.min("found").alias("label"), F.max("old").alias("old")))
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
