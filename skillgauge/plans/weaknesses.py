"""From a capability tree and results to weakness profiles, and from profiles to their assessment curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skillgauge.operators import assess, sweep, tree
from skillgauge.session import cut_lineage, written

# Fixed value: entries of the largest profile of a size sweep.
MAX_SIZE = 20


def weakness_profiles(
    leaves: DataFrame, results: DataFrame, descriptions: DataFrame, max_size: int = MAX_SIZE, alpha: float = 0.05, direction: str = "lower"
) -> DataFrame:
    """For every size up to `max_size` the profile of the latest step of the sweep that has it.

    `leaves` places instances in the tree, `results` has `instance_id`, `wins`, `trials`. Gives tree_id, profile_size, step,
    capability, a row per member, so no profile is a value of its own. The same profiles at a fixed threshold are
    `tree.weakness_profile` over `tree.node_statistics`.
    """
    stats = tree.node_statistics(tree.leaf_metrics(leaves, results), [alpha])
    ranges = sweep.step_ranges(stats, direction)
    steps = cut_lineage(sweep.profile_steps(ranges, descriptions))
    sized = steps.filter(F.col("profile_size") <= max_size).groupBy("tree_id", "profile_size").agg(F.max("step").alias("step"))
    members = sweep.profile_members(ranges, descriptions, sized)
    return members.join(sized, ["tree_id", "step"]).select("tree_id", "profile_size", "step", F.col("description").alias("capability"))


def assessment_curves(
    profiles: DataFrame, association: DataFrame, results: DataFrame, max_size: int = MAX_SIZE, keys: Sequence[str] = ()
) -> DataFrame:
    """Both curves of weakness profiles: keys, curve, size, value, best.

    `profiles` has `profile_id` and `capability`, and in `keys` what tells methods apart. Curve `entries` is the
    least mean performance of profiles with so many entries, curve `union` the least performance over the instances that belong to any
    entry, by their number; `best` is the least value in percent at that size or any larger one.
    """
    keys = list(keys)
    # Both curves read the pairs, which are joins of large tables as a rule.
    association = written(association.filter("label = 'YES'"), "association")
    belongs = profiles.select(*keys, "profile_id").distinct()
    entries = assess.profile_means(profiles, assess.capability_performance(association, results), max_size).select("profile_id", "size", F.col("val1").alias("value"))
    union = assess.union_performance(profiles, association, results).select("profile_id", F.col("num").alias("size"), F.col("val2").alias("value"))
    both = entries.withColumn("curve", F.lit("entries")).unionByName(union.withColumn("curve", F.lit("union")))
    placed = both.join(belongs, "profile_id")
    least = assess.best_per_size(placed, "size", "value", [*keys, "curve"])
    return assess.running_best(least, "size", "value", [*keys, "curve"])
