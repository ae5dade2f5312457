"""Capability trees as path tables.

A tree is a table of leaves (`tree_id`, `instance_id`, `path`): `path` lists the cluster taken at
each depth, so it names the node the instance hangs under. The root has the empty path. Every
ancestor is a prefix of the path, which turns tree recursion into explode and group-by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.functions.binomial import exact_interval
from skillgauge.functions.metrics import significant
from skillgauge.session import broadcast_if_few, cut_lineage

# Interval levels, fewest instances for an interval, size from which a child is tested.
ALPHAS = (0.01, 0.05)
MIN_INTERVAL_SIZE = 5
BIG_CHILD = 20

NODE = ["tree_id", "path"]


def prefixes(path: Column, proper: bool = False) -> Column:
    """All prefixes of a path from the root on, with or without the path itself."""
    depth = F.size(path)
    lengths = F.sequence(F.lit(0), depth)
    if proper:
        lengths = F.filter(lengths, lambda n: n < depth)
    return F.transform(lengths, lambda n: F.slice(path, F.lit(1), n))


def parent(path: Column) -> Column:
    """Path of the parent; null at the root."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))


def path_text(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), "/")


def leaf_metrics(leaves: DataFrame, results: DataFrame, key: str = "instance_id") -> DataFrame:
    """C4: leaves with the `wins` and `trials` of their instance."""
    return leaves.join(results.select(key, "wins", "trials"), key, "inner")


def roll_up(leaves: DataFrame) -> DataFrame:
    """`size`, `sum_metrics` and `trials` of every inner node.

    Instances are first added up per node they hang under; only those sums are copied to the
    ancestors. Both steps combine inside map tasks, so the root is no hot spot.
    """
    own = leaves.groupBy(*NODE).agg(
        F.count("*").alias("size"), F.sum("wins").alias("sum_metrics"), F.sum("trials").alias("trials")
    )
    return (
        own.withColumn("path", F.explode(prefixes(F.col("path"))))
        .groupBy(*NODE)
        .agg(*[F.sum(name).alias(name) for name in ("size", "sum_metrics", "trials")])
        .withColumn("depth", F.size("path"))
    )


def roll_up_scores(leaves: DataFrame, score: str = "score") -> DataFrame:
    """Mean of a score per node over the instances that have one (-1 means none).

    Scores are added up as decimals, so that a mean does not depend on the order of additions; where one does not fit
    15 decimals and 23 digits before them, as doubles.
    """
    own = (
        leaves.filter(F.col(score) != -1)
        .withColumn("_exact", F.col(score).try_cast("decimal(38,15)"))
        .groupBy(*NODE)
        .agg(F.count("*").alias("size"), F.sum(score).alias("total"), F.try_sum("_exact").alias("_exact"), F.bool_and(F.col("_exact").isNotNull()).alias("_fits"))
    )
    summed = own.withColumn("path", F.explode(prefixes(F.col("path")))).groupBy(*NODE).agg(
        F.sum("size").alias("size"), F.sum("total").alias("total"), F.try_sum("_exact").alias("_exact"), F.bool_and("_fits").alias("_fits")
    )
    total = F.when(F.col("_fits"), F.coalesce(F.col("_exact").cast("double"), F.col("total"))).otherwise(F.col("total"))
    return summed.select(*NODE, "size", (total / F.col("size")).alias("mean_score"))


def with_intervals(nodes: DataFrame, alphas: Sequence[float] = ALPHAS, min_size: int = MIN_INTERVAL_SIZE) -> DataFrame:
    """One row per node and level with `lo` and `hi`; nodes under the smallest size get nulls."""
    levels = F.explode(F.array(*[F.lit(float(alpha)) for alpha in alphas]))
    measured = F.col("size") >= min_size
    return (
        nodes.withColumn("alpha", levels)
        .withColumn(
            "_interval",
            exact_interval(
                F.when(measured, F.col("sum_metrics")), F.when(measured, F.col("trials")), F.col("alpha")
            ),
        )
        .withColumns({"lo": F.col("_interval.lo"), "hi": F.col("_interval.hi")})
        .drop("_interval")
    )


def node_statistics(
    leaves: DataFrame, alphas: Sequence[float] = ALPHAS, min_size: int = MIN_INTERVAL_SIZE
) -> DataFrame:
    """Sizes, metric sums and exact intervals of every inner node."""
    return with_intervals(roll_up(leaves), alphas, min_size)


def _candidates(stats: DataFrame, threshold: float, direction: str) -> DataFrame:
    passes = F.coalesce(significant(F.col("lo"), F.col("hi"), threshold, direction), F.lit(False))
    tested = stats.withColumn("passes", passes)
    blocked = (
        tested.filter((F.size("path") > 0) & (F.col("size") >= BIG_CHILD) & ~F.col("passes"))
        .select("tree_id", parent(F.col("path")).alias("path"))
        .distinct()
    )
    return tested.filter("passes").join(blocked, NODE, "left_anti")


def extract_nodes(stats: DataFrame, threshold: float, direction: str = "lower") -> DataFrame:
    """I4: the topmost nodes that pass the test together with all their big children.

    `stats` holds one interval level. A node qualifies by itself and its children alone; the
    extracted ones are those without a qualifying proper ancestor, so one anti join replaces the
    descent. The node table is read several times, so it is materialised first.
    """
    qualified = _candidates(cut_lineage(stats), threshold, direction)
    ancestors = qualified.select(*NODE, F.explode(prefixes(F.col("path"), proper=True)).alias("_ancestor"))
    covered = (
        ancestors.join(
            qualified.select("tree_id", F.col("path").alias("_ancestor")), ["tree_id", "_ancestor"], "left_semi"
        )
        .select(*NODE)
        .distinct()
    )
    return qualified.join(covered, NODE, "left_anti").drop("passes")


def with_descriptions(nodes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Nodes with the description at the same place of the same tree."""
    return nodes.join(descriptions.select(*NODE, "description"), NODE, "inner")


def _nodes_above(placed: DataFrame, nodes: DataFrame, proper: bool) -> DataFrame:
    """For every path at which instances hang, the given nodes on the way to it.

    Works on distinct paths, of which there are far fewer than instances, so neither the instances nor
    the root, which lies on every way, are multiplied.
    """
    ends = placed.select(*NODE).distinct().withColumnRenamed("path", "end_path")
    ways = ends.withColumn("path", F.explode(prefixes(F.col("end_path"), proper)))
    return cut_lineage(ways.join(broadcast_if_few(nodes), NODE, "inner"))


def _attach(placed: DataFrame, above: DataFrame) -> DataFrame:
    return placed.withColumnRenamed("path", "end_path").join(broadcast_if_few(above), ["tree_id", "end_path"], "inner")


def instances_on_path(located: DataFrame, nodes: DataFrame) -> DataFrame:
    """Located instances joined to the nodes they pass on the way down.

    The node an instance ends in is not passed, so only proper prefixes of its path count.
    """
    return _attach(located, _nodes_above(located, nodes, proper=True))


def instances_below(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The leaves under each of some nodes, one row per node and leaf."""
    placed = leaves.select("tree_id", "instance_id", "path")
    return _attach(placed, _nodes_above(placed, nodes, proper=False)).drop("end_path")


def weakness_profile(
    stats: DataFrame, descriptions: DataFrame, leaves: DataFrame, threshold: float, direction: str = "lower"
) -> DataFrame:
    """Extracted nodes with description and the instances below, one row per node and instance."""
    extracted = with_descriptions(extract_nodes(stats, threshold, direction).select(*NODE, "size"), descriptions)
    return instances_below(extracted, leaves).select(
        *NODE, F.col("description").alias("capability"), "size", "instance_id"
    )
