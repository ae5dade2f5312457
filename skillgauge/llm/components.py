"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgauge.llm.storage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node passes its smallest neighbour to its larger (or to its smaller) neighbours.

    Smallest neighbours are aggregates and links join them, so a node with very many neighbours is
    combined in the map tasks and its join can be split.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    joined = both.join(lowest, both["a"] == lowest["node"])
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    passed = joined.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = lowest.filter(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    return passed.unionByName(own).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """a, b (numbers) -> node, component: the smallest node that can be reached. Nodes without a link are absent.

    Alternates the two star steps until nothing changes; the number of steps grows with the logarithm
    of the longest path, and the links of a step are never more than before.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    ordered = stored(ordered, "links")
    before = None
    while True:
        seen = ordered.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("sum"), F.bit_xor(F.xxhash64("a", "b")).alias("xor")).first()
        if seen == before:
            break
        before = seen
        ordered = stored(_star(_star(ordered, large=True), large=False), "links")
    roots = ordered.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ordered.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
