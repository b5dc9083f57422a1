"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import settle


def _stars(edges: DataFrame) -> DataFrame:
    """Tie every node's larger neighbours, then its smaller ones, to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, v``: for each node of ``links`` (``u``, ``v``) but the smallest of its component, that smallest node.

    Links may repeat, point either way, or join a node with itself. Each round writes its
    edges to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = settle(
        links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            return edges
        seen = tuple(mark)
        edges = settle(_stars(edges), "stars")
