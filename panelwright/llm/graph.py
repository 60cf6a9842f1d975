"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that can be reached; only nodes with an edge appear.

    Each round rewires every node's larger neighbours, then its smaller ones, to the least
    neighbour.  The number of edges never grows, and the rounds end when nothing changes.
    """
    up = F.greatest(a, b).alias("up"), F.least(a, b).alias("down")
    edges = keep(edges.where(F.col(a) != F.col(b)).select(*up).distinct())
    before = None
    while True:
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("up", "down").cast("decimal(20,0)"))).first()
        if after == before:
            return edges.select(F.col("up").alias("node"), F.col("down").alias("label")).unionByName(
                edges.select(F.col("down").alias("node"), F.col("down").alias("label")).distinct()
            )
        before = after
        both = edges.unionByName(edges.select(F.col("down").alias("up"), F.col("up").alias("down")))
        least = both.groupBy("up").agg(F.least("up", F.min("down")).alias("least"))
        large = both.where("down > up").join(least, "up").select(F.col("down").alias("up"), F.col("least").alias("down")).distinct()
        least = large.groupBy("up").agg(F.min("down").alias("least"))
        small = large.join(least, "up").select(F.col("down").alias("up"), F.col("least").alias("down")).where("up <> down")
        edges = keep(small.unionByName(least.select("up", F.col("least").alias("down"))).distinct())
