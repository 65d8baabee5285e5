"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import kept


def star_components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node can reach.

    ``links`` has columns ``a`` and ``b`` (long). Returns ``node``, ``root``, one row for every
    node of a link that is not its own root. Alternates large and small stars until the links
    stand still, which takes a number of rounds that grows with the logarithm of the nodes.
    Every round is written to the shared folder; nothing but a count and a checksum is collected.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.toDF("a", "b"))
        edges = kept(small.where("a <> b").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.toDF("node", "root")
        seen = state
