"""Connected components of a distributed edge table (large-star / small-star).

Edges stay in Spark; only two numbers a round (row count and a hash sum) reach the driver to see
that nothing changes any more. Each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import discard, save


def stars(edges: DataFrame) -> DataFrame:
    """(node, least): every node of ``edges`` (a, b: bigint) but the least of its component.

    Large-star links each larger neighbour of a node to the least of its neighbourhood, small-star
    the smaller ones; both keep connectivity and end in one star per component. The least of each
    neighbourhood is a written table, so the join with it is between two plain exchanges and a hub's
    partition is split by Spark.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = save(large, "large-star")
        least2 = save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least2, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = save(small.where("a <> b").distinct(), "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (edges, least, large, least2):
            discard(old)
        edges = after
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
        seen = now
