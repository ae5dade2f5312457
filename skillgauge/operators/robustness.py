"""Per-question robustness of an evaluation log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from skillgauge.functions.answers import choice_position
from skillgauge.functions.metrics import round3
from skillgauge.operators.filters import unbiased_order

CONFIGURATION = ["model", "language", "dataset", "shots"]


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order; without the key columns nothing changes.

    `row_number() = 1` makes Spark keep one row per key in each map task before the shuffle, so a
    key that holds much of the table does not end up in one task.
    """
    if not set(keys) <= set(df.columns):
        return df
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def question_robustness(log: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
    """D1 without the text: total, count and rounded mean score per question.

    Only fixed-width values are aggregated, so the hash aggregate and its map-side step apply.
    `first_evaluation` names the first row that has a question text: a log without its texts says so in
    `has_text`, one with them needs nothing more.
    """
    has_text = F.col("has_text") if "has_text" in log.columns else F.col("raw_input").isNotNull()
    return (
        log.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.sum("score").alias("total_score"),
            F.count("score").alias("instance_count"),
            round3(F.avg("score")).alias("average_score"),
            F.min(F.when(has_text, F.col("evaluation_id"))).alias("first_evaluation"),
        )
    )


def question_accuracy(log: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
    """Correct and total counts and rounded accuracy; null accuracy when nothing was scored."""
    return (
        log.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.sum("score").alias("correct_count"), F.count("score").alias("total_count"))
        .withColumn("accuracy", round3(F.try_divide("correct_count", "total_count")))
    )


def model_counts(log: DataFrame) -> DataFrame:
    """D3."""
    return log.groupBy("model").agg(F.count("*").alias("rows"))


def question_configurations(log: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
    """How many perturbed prompts each question has and what they scored together."""
    return (
        log.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("configurations"), F.sum("score").alias("total_score"))
    )


def low_performer_summary(scores: DataFrame, threshold: float, column: str = "average_score") -> DataFrame:
    """Score range and share of low performers over all questions."""
    low = F.coalesce(F.col(column) < threshold, F.lit(False))
    return scores.agg(
        F.min(column).alias("min_score"),
        F.max(column).alias("max_score"),
        F.count_if(low).alias("low_count"),
        F.count("*").alias("total_count"),
        F.avg(low.cast("int")).alias("low_share"),
    )


def first_low_performers(scores: DataFrame, n: int, threshold: float, key: str = "sample_index") -> DataFrame:
    """the first n low performers by question, for a report."""
    return scores.filter(F.col("average_score") < threshold).orderBy(key).limit(n)


def keep_low_rows(log: DataFrame, low: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
    """Every raw row of a low-performing question."""
    return log.join(low.select(*keys), list(keys), "left_semi")


def examples_for_rows(log: DataFrame, examples: DataFrame, keys: Sequence[str] = ("dataset", "sample_index")) -> DataFrame:
    """Attach each row's benchmark example and the position of its answer among the choices.

    Rows without an example, and rows whose answer is none of the choices, are dropped.
    """
    found = log.join(examples, list(keys), "inner").withColumn("chosen_position", choice_position(F.col("closest_answer"), F.col("choices")))
    return found.dropna(subset=["chosen_position"])


def configurations(
    spark: SparkSession,
    models: Sequence[str],
    languages: Sequence[str],
    shots: Sequence[int],
    benchmarks: Sequence[str],
    repos: Sequence[str] = ("local",),
) -> DataFrame:
    """Every requested combination, one row each. Sized by the request, not by any table."""
    axes = {
        "repo": list(repos),
        "model": list(models),
        "language": list(languages),
        "shots": list(shots),
        "dataset": [name.removesuffix(".parquet") for name in benchmarks],
    }
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(value) for value in values])))
    return grid.drop("id")


def restrict_to(log: DataFrame, grid: DataFrame, keys: Sequence[str] = tuple(CONFIGURATION)) -> DataFrame:
    """C12 applied: rows of the requested configurations, all in one job."""
    return log.join(grid.select(*keys).distinct(), list(keys), "left_semi")


def configuration_status(clean: DataFrame, grid: DataFrame, threshold: float, failed: DataFrame | None = None) -> DataFrame:
    """Outcome of each requested configuration, from one aggregation of the deduplicated log.

    Counts per question first, then per configuration; a question without a key belongs to no group. A configuration in
    `failed` (the keys, and a `status` such as `error` or `save_error`) has that status whatever else was read of it: see
    `broken_files` and `save_status`.
    """
    kept = unbiased_order()
    average = round3(F.avg(F.when(kept, F.col("score"))))
    stages = (
        clean.groupBy("sample_index", *CONFIGURATION)
        .agg(F.count("*").alias("loaded"), F.count_if(kept).alias("kept"), average.alias("average_score"))
        .groupBy(*CONFIGURATION)
        .agg(
            F.sum("loaded").alias("loaded"),
            F.sum("kept").alias("initial_rows"),
            F.count_if((F.col("kept") > 0) & F.col("sample_index").isNotNull()).alias("grouped_samples"),
            F.count_if((F.col("average_score") < threshold) & F.col("sample_index").isNotNull()).alias(
                "low_performer_samples"
            ),
        )
    )
    counts = ["loaded", "initial_rows", "grouped_samples", "low_performer_samples"]
    joined = grid.join(stages, CONFIGURATION, "left").fillna(0, counts)
    if failed is None:
        joined = joined.withColumn("_failed", F.lit(None).cast("string"))
    else:
        joined = joined.join(failed.groupBy(*CONFIGURATION).agg(F.min("status").alias("_failed")), CONFIGURATION, "left")
    return (
        joined.withColumn(
            "status",
            F.when(F.col("_failed").isNotNull(), F.col("_failed"))
            .when(F.col("loaded") == 0, "empty")
            .when(F.col("initial_rows") == 0, "empty_after_filters")
            .when(F.col("grouped_samples") == 0, "no_samples_after_grouping")
            .when(F.col("low_performer_samples") == 0, "no_low_performers")
            .otherwise("success"),
        )
        .drop("_failed")
    )


def save_status(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """`save_error` for every configuration of `wanted` with other counts of rows than `saved`, the written table read back."""
    rows = lambda df, name: df.groupBy(*CONFIGURATION).agg(F.count("*").alias(name))
    both = rows(wanted, "_wanted").join(rows(saved, "_saved"), CONFIGURATION, "left")
    return both.filter(~F.col("_wanted").eqNullSafe(F.col("_saved"))).select(*CONFIGURATION, F.lit("save_error").alias("status"))


def answer_status(status: DataFrame, low_rows: DataFrame, answers_present: bool = True) -> DataFrame:
    """D6 for the answer analysis: a configuration whose low rows map to no position at all is
    `invalid_mappings`; without an answer column mapping is skipped."""
    if not answers_present:
        return status.withColumn(
            "status", F.when(F.col("status") == "success", "mapping_skipped").otherwise(F.col("status"))
        )
    mapped = low_rows.groupBy(*CONFIGURATION).agg(
        F.count("*").alias("low_performer_rows"), F.count("chosen_position").alias("mapped_rows")
    )
    return (
        status.join(mapped, CONFIGURATION, "left")
        .fillna(0, ["low_performer_rows", "mapped_rows"])
        .withColumn(
            "status",
            F.when((F.col("status") == "success") & (F.col("mapped_rows") == 0), "invalid_mappings").otherwise(
                F.col("status")
            ),
        )
    )


def status_counts(status: DataFrame) -> DataFrame:
    """Configurations per outcome."""
    return status.groupBy("status").agg(F.count("*").alias("configurations"))


def extract_totals(raw: DataFrame, clean: DataFrame, unique_key: str = "evaluation_id") -> DataFrame:
    """Raw, processed and unique rows per model of an extract."""
    unique = raw.select("model", unique_key).distinct().groupBy("model").agg(F.count(unique_key).alias("unique_rows"))
    totals = raw.groupBy("model").agg(F.count("*").alias("raw_rows"))
    processed = clean.groupBy("model").agg(F.count("*").alias("processed_rows"))
    return (
        totals.join(processed, "model", "left")
        .join(unique, "model", "left")
        .fillna(0, ["processed_rows", "unique_rows"])
    )
