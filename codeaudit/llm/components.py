"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected `edges` (a, b): each node of an edge
    with the smallest node it reaches.  Each round points every node at the
    least of its neighbours through aggregates and joins, so a hub's edges are
    never gathered in one task; rounds grow with the logarithm of the longest
    path.  Written tables cut the lineage between rounds."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
            "a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
                                                        ).alias("x")).select("x.*").filter("a <> b").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
