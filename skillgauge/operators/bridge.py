"""Robustness of questions on a capability tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from skillgauge.functions.text import question_text, strip

# Fixed value: score of a question that has none.
NO_SCORE = -1.0
# Ranges of distinct values that ranks are counted in.
RANK_RANGES = 64


def question_scores(catalogue: DataFrame, scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """C1, right side: one score per question text, that of its first place in the catalogue.

    When the first place has no score the text has none, even if a later place has one.
    """
    first = catalogue.groupBy(strip(F.col("question")).alias("question")).agg(
        F.min(F.struct(*order, F.col("idx").alias("_idx"))).alias("_first")
    )
    return (
        first.select("question", F.col("_first._idx").alias("idx"))
        .join(scores, "idx", "left")
        .select("question", F.coalesce("score", F.lit(NO_SCORE)).alias("score"))
    )


def lookup_scores(questions: DataFrame, catalogue: DataFrame, scores: DataFrame, order: Sequence[str], column: str = "question") -> DataFrame:
    """Every question with its score, -1 when its text or the score is not there."""
    known = question_scores(catalogue, scores, order).withColumnRenamed("question", "_text")
    keyed = questions.withColumn("_text", strip(F.col(column)))
    return keyed.join(known, "_text", "left").fillna(NO_SCORE, ["score"]).drop("_text")


def scored_tree(nodes: DataFrame, catalogue: DataFrame, scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """The nodes of a tree whose input is a question, with the question and its score.

    Every child is visited, whether its parent lists its children or keys them by cluster.
    """
    asked = nodes.withColumn("question", question_text(F.col("input"))).filter(F.col("question").isNotNull())
    return lookup_scores(asked, catalogue, scores, order)


def _average_ranks(rows: DataFrame, value: str, rank: str) -> DataFrame:
    """Average rank of each distinct value.

    Distinct values are cut into even ranges at estimated quantiles; ranks add up inside a range and
    over the few ranges, so no window holds all values.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    shares = [k / RANK_RANGES for k in range(1, RANK_RANGES)]
    cuts = F.lit(counts.agg(F.percentile_approx(value, shares, 10_000)).first()[0] or [])
    parted = counts.withColumn("_range", F.size(F.filter(cuts.cast("array<double>"), lambda cut: cut < F.col(value))))
    sums = parted.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    upto = F.sum("_n").over(W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parted.withColumn("_upto", upto).join(starts, "_range")
    return placed.select(F.col(value).alias(f"_{rank}"), (F.col("_start") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(rank))


def correlations(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson and Spearman correlation of two scores, and the number of pairs that have both.

    Values are taken as they are; ties share their average rank. A correlation with a constant is null.
    """
    rows = pairs.select(F.col(left).cast("double").alias("x"), F.col(right).cast("double").alias("y")).dropna()
    by_x, by_y = _average_ranks(rows, "x", "rx"), _average_ranks(rows, "y", "ry")
    ranked = rows.join(by_x, rows["x"] == by_x["_rx"]).join(by_y, rows["y"] == by_y["_ry"])

    def correlation(a: str, b: str):
        return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))

    return ranked.agg(
        correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"), F.count("*").alias("questions")
    )


def robustness_groups(questions: DataFrame, threshold: float, category: str = "category", score: str = "score", skill: str = "skill") -> DataFrame:
    """Per category the questions of high and low robustness, with their mean robustness and skill."""
    group = F.when(F.col(score) >= threshold, "high").otherwise("low")
    return (
        questions.dropna(subset=[score])
        .groupBy(category, group.alias("robustness"))
        .agg(F.count("*").alias("questions"), F.avg(score).alias("mean_score"), F.avg(skill).alias("mean_skill"))
    )
