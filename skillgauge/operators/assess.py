"""Scoring of weakness profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from skillgauge.functions.metrics import attacked_probability, draw, success_ratio
from skillgauge.functions.text import ratio_label
from skillgauge.operators.indexing import shuffled_index
from skillgauge.session import broadcast_if_few, broadcast_if_small, cut_lineage


def associated(association: DataFrame) -> DataFrame:
    """Capability and instance pairs labelled YES."""
    return association.filter("label = 'YES'").select("capability", "instance_id")


def capability_performance(association: DataFrame, results: DataFrame) -> DataFrame:
    """Success ratio over the instances of each capability.

    `results` has `instance_id`, `wins`, `trials`. Capabilities without instances do not appear;
    whoever looks one up counts it as 1.0.
    """
    return (
        associated(association)
        .join(results.select("instance_id", "wins", "trials"), "instance_id")
        .groupBy("capability")
        .agg(F.count("*").alias("instances"), success_ratio(F.col("wins"), F.col("trials")).alias("performance"))
    )


def profile_means(profiles: DataFrame, performance: DataFrame, max_size: int | None = None) -> DataFrame:
    """Per profile its size and mean performance over its entries, repeated entries counted again."""
    scored = (
        profiles.join(performance.select("capability", "performance"), "capability", "left")
        .groupBy("profile_id")
        .agg(F.count("*").alias("size"), F.avg(F.coalesce("performance", F.lit(1.0))).alias("val1"))
    )
    return scored if max_size is None else scored.filter(F.col("size") <= max_size)


def _numbered(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profiles with a number each, from 1, and their keys as one text, which no null key lacks."""
    named = profiles.select(*keys).distinct().withColumn("_key", F.to_json(F.struct(*keys)))
    return cut_lineage(shuffled_index(named, 0, "_key").withColumn("_number", (F.col("index") + 1).cast("int")).drop("index"))


def _listed(profiles: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per capability the numbers of the profiles it belongs to."""
    named = profiles.select(F.to_json(F.struct(*keys)).alias("_key"), "capability").distinct()
    return named.join(broadcast_if_few(numbered.select("_key", "_number")), "_key").groupBy("capability").agg(F.collect_list("_number").alias("_numbers"))


def _looked_up(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs with the list of their capability, dealt by instance.

    The pairs are dealt out before they meet the lists, so that no list is shuffled and no frequent capability meets in one task.
    """
    listed = cut_lineage(listed)
    return pairs.repartition("instance_id").join(broadcast_if_small(listed, 4 * F.size("_numbers") + 100), "capability")


def _profiles_of_instances(pairs: DataFrame, profiles: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per instance the numbers of the profiles any of its capabilities belongs to.

    Profiles are listed per capability first, so a pair meets one list instead of one row per profile,
    and an instance ends with at most one entry per profile.
    """
    listed = _listed(profiles, numbered, keys)
    return _looked_up(pairs, listed).groupBy("instance_id").agg(F.array_distinct(F.flatten(F.collect_list("_numbers"))).alias("_numbers"))


def profile_members(profiles: DataFrame, association: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """The distinct instances of all entries of each profile, a row each."""
    keys = list(keys)
    numbered = _numbered(profiles, keys)
    members = _profiles_of_instances(associated(association), profiles, numbered, keys).select("instance_id", F.explode("_numbers").alias("_number"))
    return members.join(broadcast_if_few(numbered), "_number").select(*keys, "instance_id")


def union_performance(profiles: DataFrame, association: DataFrame, results: DataFrame) -> DataFrame:
    """Per profile the number of distinct instances of all its entries and their success ratio."""
    numbered = _numbered(profiles, ["profile_id"])
    members = _profiles_of_instances(associated(association), profiles, numbered, ["profile_id"]).join(
        results.select("instance_id", "wins", "trials"), "instance_id"
    )
    scored = (
        members.select(F.explode("_numbers").alias("_number"), "wins", "trials")
        .groupBy("_number")
        .agg(F.count("*").alias("num"), F.sum("wins").alias("wins"), F.sum("trials").alias("trials"))
    )
    return (
        numbered.join(scored, "_number", "left")
        .select(
            "profile_id",
            F.coalesce("num", F.lit(0)).alias("num"),
            F.coalesce(F.try_divide("wins", "trials"), F.lit(1.0)).alias("val2"),
        )
    )


def best_per_size(scored: DataFrame, size: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The least value per size."""
    return scored.groupBy(*keys, size).agg(F.min(value).alias(value))


def running_best(curve: DataFrame, size: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percent of the least value at this size or any larger one.

    A curve has one row per size; name the columns that tell curves apart in `keys`.
    """
    larger = W.partitionBy(*keys).orderBy(size).rowsBetween(W.currentRow, W.unboundedFollowing)
    return curve.withColumn("best", F.min(value).over(larger) * 100.0)


def overlap(truth: DataFrame, predicted: DataFrame, association: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """D15, long form: for each true and predicted capability the share its instances have in the other side's union.

    `truth` holds `capability`, `predicted` holds `keys` and `capability`. One row per profile, side
    and capability, with the counts behind the share. The association table is read once: it is
    gathered per instance, and every count is a sum over instances.
    """
    keys = list(keys)
    truth, predicted = truth.select("capability").distinct(), predicted.select(*keys, "capability").distinct()
    numbered = _numbered(predicted, keys)
    listed = _listed(predicted, numbered, keys)
    none = F.array().cast("array<int>")
    roles = listed.join(truth.withColumn("_true", F.lit(True)), "capability", "full").select(
        "capability", F.coalesce("_true", F.lit(False)).alias("_true"), F.coalesce("_numbers", none).alias("_numbers")
    )
    roles = cut_lineage(shuffled_index(roles, 0, "capability").withColumn("_capability", F.col("index").cast("int")).drop("index"))
    per_instance = _looked_up(associated(association), roles).groupBy("instance_id").agg(
        F.collect_list(F.struct("_capability", "_true")).alias("_all"),
        F.max(F.col("_true").cast("int")).alias("_planted"),
        F.array_distinct(F.flatten(F.collect_list("_numbers"))).alias("_numbers"),
    )
    # Number 0 counts a capability's instances and those of them that the truth covers.
    own = F.array(F.lit(0))
    events = per_instance.select(F.inline("_all"), "_planted", "_numbers").select(
        "_capability", "_planted", F.explode(F.when(F.col("_true"), F.concat(own, "_numbers")).otherwise(own)).alias("_number")
    )
    counted = cut_lineage(events.groupBy("_number", "_capability").agg(F.count("*").alias("n"), F.sum("_planted").alias("planted")))
    counts = counted.join(broadcast_if_few(roles.select("_capability", "capability")), "_capability").drop("_capability")
    totals = counts.filter("_number = 0").select("capability", F.col("n").alias("whole"), "planted")
    # Every profile answers for every true capability: two short lists, profiles and planted weaknesses.
    all_true = truth.agg(F.collect_list("capability")).scalar()
    recall = (
        numbered.select(*keys, "_number", F.explode(all_true).alias("capability"))
        .join(counts.select("_number", "capability", F.col("n").alias("part")), ["_number", "capability"], "left")
        .join(totals.select("capability", "whole"), "capability", "left")
        .select(*keys, "capability", F.lit("recall").alias("side"), "part", "whole")
    )
    precision = predicted.join(totals, "capability", "left").select(
        *keys, "capability", F.lit("precision").alias("side"), F.col("planted").alias("part"), "whole"
    )
    return (
        recall.unionByName(precision)
        .fillna(0, ["part", "whole"])
        .withColumns(
            {
                "ratio": F.coalesce(F.try_divide(F.col("part").cast("double"), F.col("whole")), F.lit(0.0)),
                "label": ratio_label(F.col("part"), F.col("whole")),
            }
        )
    )


def overlap_report(rows: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Average recall and precision per profile and their harmonic mean, 0 when both are 0."""
    recall = F.coalesce(F.avg(F.when(F.col("side") == "recall", F.col("ratio"))), F.lit(0.0))
    precision = F.coalesce(F.avg(F.when(F.col("side") == "precision", F.col("ratio"))), F.lit(0.0))
    return (
        rows.groupBy(*keys)
        .agg(recall.alias("recall"), precision.alias("precision"))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)
            ),
        )
    )


def best_f1(reports: DataFrame, keys: Sequence[str] = ("dataset", "drate", "method")) -> DataFrame:
    """Best F1 over the profile sizes of each method."""
    return reports.groupBy(*keys).agg(F.max("f1").alias("best_f1"))


def located_performance(flags: DataFrame, results: DataFrame, keys: Sequence[str] = ("threshold",)) -> DataFrame:
    """Number and mean result of the extracted instances per threshold."""
    return (
        flags.filter("extracted")
        .join(results.select("instance_id", "result"), "instance_id")
        .groupBy(*keys)
        .agg(F.count("*").alias("instances"), F.avg("result").alias("performance"))
    )


def overall_mean(results: DataFrame, value: str = "result") -> DataFrame:
    """The reference line of a curve."""
    return results.agg(F.avg(value).alias("overall"), F.count(value).alias("instances"))


def mean_and_error(runs: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and standard error over repeated runs (population spread); one run has no error."""
    spread = F.stddev_pop(value) / F.sqrt(F.count(value))
    return runs.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.when(F.count(value) > 1, spread).alias("stderr"), F.count(value).alias("runs")
    )


def union_members(sets: DataFrame, keys: Sequence[str], member: str = "instance_id") -> DataFrame:
    """Distinct members of the union of sets, per key."""
    return sets.select(*keys, member).distinct()


def intersection_ratio(left: DataFrame, right: DataFrame, keys: Sequence[str], member: str = "instance_id") -> DataFrame:
    """How much of each left set lies in the right set; 0 for an empty set."""
    inside = left.join(right.select(member).distinct().withColumn("_in", F.lit(1)), member, "left")
    return (
        inside.groupBy(*keys)
        .agg(F.count("_in").alias("part"), F.count(member).alias("whole"))
        .withColumn("ratio", F.coalesce(F.try_divide("part", "whole"), F.lit(0.0)))
    )


def set_differences(left: DataFrame, right: DataFrame, member: str = "instance_id") -> DataFrame:
    """Distinct members missing on either side; both counts are 0 for equal sets, the first for a subset."""
    sides = left.select(member, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(member, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    members = sides.groupBy(member).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return members.agg(F.count_if(F.col("l") > F.col("r")).alias("only_left"), F.count_if(F.col("r") > F.col("l")).alias("only_right"))


def planted_counts(instances: DataFrame, association: DataFrame, planted: DataFrame) -> DataFrame:
    """H16 input: how many planted weaknesses each instance has, 0 included."""
    hits = (
        associated(association)
        .join(planted.select("capability").distinct(), "capability", "left_semi")
        .groupBy("instance_id")
        .agg(F.count("*").alias("planted"))
    )
    return instances.select("instance_id").join(hits, "instance_id", "left").fillna(0, ["planted"])


def synthetic_results(
    instances: DataFrame, association: DataFrame, planted: DataFrame, base: float, decay: float, seed: int, draws: int = 1
) -> DataFrame:
    """Results drawn from planted weaknesses; two draws stand for two presentation orders."""
    probability = attacked_probability(base, decay, F.col("planted"))
    wins = sum((draw(probability, seed, F.col("instance_id"), turn) for turn in range(1, draws)), draw(probability, seed, F.col("instance_id")))
    return planted_counts(instances, association, planted).select(
        "instance_id", "planted", probability.alias("probability"), wins.alias("wins"), F.lit(draws).alias("trials")
    )
