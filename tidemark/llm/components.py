"""Connected components over a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _contracted(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest one.

    With `both_ways` a node looks at all its neighbours and re-links the larger ones; without, it looks at
    the smaller ones only. The smallest is aggregated before the shuffle, and the join back to the links
    can be split by the engine, so a node with a great many links is no single task's work.
    """
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least")
    )
    linked = edges.join(least, F.col("a") == F.col("node"))
    if both_ways:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b) of longs to (node, root): each linked node with the smallest node of its component.

    Nodes without a link to another node are not returned. Each round is written as a table in the shared
    folder; rounds grow with the logarithm of the longest chain. An empty table gives an empty result.
    Links with a null end are ignored.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = None
    while True:
        mark = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("t"),
        ).first()
        if not mark["n"] or mark == seen:
            break
        seen = mark
        edges = staged(_contracted(_contracted(edges, True), False), "links")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
