"""Projections and filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.functions.text import TURN_START, strip, token_count

# Option orders that leak the answer when examples are shown.
BIASED_ORDERS = ["correct_first", "correct_last"]
FEW_SHOTS = 5
# A reply of one zero-width space is no reply.
ZERO_WIDTH_SPACE = "\u200b"


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """B1: drop the listed columns that exist."""
    return df.drop(*columns)


def _equalities(df: DataFrame, wanted: dict[str, object]) -> list[Column]:
    return [F.col(name) == value for name, value in wanted.items() if value is not None and name in df.columns]


def select_runs(
    log: DataFrame,
    model: str,
    shots: int,
    benchmarks: Sequence[str] | None = None,
    **dimensions: str | None,
) -> DataFrame:
    """Rows of one model and shot count, optionally of some benchmarks and prompt dimensions.

    `dimensions` are `enumerator`, `separator`, `choices_order` and `instruction_phrasing`; one that
    is None or not a column is no condition, and so is `template`.
    """
    wanted = {"model": model, "shots": shots} | {k: v for k, v in dimensions.items() if k != "template"}
    conditions = _equalities(log, wanted)
    if benchmarks is not None:
        conditions.append(F.col("dataset").isin([name.removesuffix(".parquet") for name in benchmarks]))
    return log.filter(reduce(and_, conditions))


def select_runs_older(
    log: DataFrame,
    model: str,
    shots: int,
    dataset: str | None = None,
    template: str | None = None,
    separator: str | None = None,
    enumerator: str | None = None,
    choices_order: str | None = None,
) -> DataFrame:
    """The same over the older log columns, where `template` is a condition like the others."""
    wanted = {
        "model": model,
        "shots": shots,
        "dataset": dataset,
        "template": template,
        "separator": separator,
        "enumerator": enumerator,
        "choices_order": choices_order,
    }
    return log.filter(reduce(and_, [F.col(name) == value for name, value in wanted.items() if value is not None]))


def unbiased_order() -> Column:
    """B5 as a condition: not a few-shot run with a biased option order. An unknown order is kept."""
    biased = F.coalesce(F.col("choices_order").isin(BIASED_ORDERS), F.lit(False))
    return ~F.col("shots").eqNullSafe(FEW_SHOTS) | ~biased


def drop_biased_orders(log: DataFrame) -> DataFrame:
    """A log without both columns passes unchanged."""
    return log.filter(unbiased_order()) if {"shots", "choices_order"} <= set(log.columns) else log


def low_performers(scores: DataFrame, threshold: float, column: str = "average_score") -> DataFrame:
    """Rows whose already rounded score is under the threshold; a null score is no low score."""
    return scores.filter(F.col(column) < threshold)


def select_split(instances: DataFrame, split: DataFrame | None, complement: bool = False, key: str = "instance_id") -> DataFrame:
    """All instances, those of a split, or (G1) those outside it."""
    if split is None:
        return instances
    return instances.join(split.select(key), key, "left_anti" if complement else "left_semi")


def topic_starts_with(df: DataFrame, prefix: str, column: str = "data_topic") -> DataFrame:
    """B8."""
    return df.filter(F.col(column).startswith(prefix))


def _spoken(text: str) -> Column:
    return strip(F.col(text)) != ""


def role_tagged_dialogues(turns: DataFrame, first: str = "human", second: str = "gpt") -> DataFrame:
    """B9, role form: two turns or more, the right speakers, neither blank, a visible reply.

    Works on one row per conversation with `turns`, `role_0`, `text_0`, `role_1`, `text_1`; where an
    `id` string is present it must end in `_0`.
    """
    valid = turns.filter(
        (F.col("turns") >= 2)
        & (F.col("role_0") == first)
        & (F.col("role_1") == second)
        & _spoken("text_0")
        & _spoken("text_1")
        & (F.col("text_1") != ZERO_WIDTH_SPACE)
    )
    return valid.filter(F.col("id").endswith("_0")) if "id" in turns.columns else valid


def language_tagged_dialogues(turns: DataFrame, language: str = "English") -> DataFrame:
    """B9, language form: two turns or more, both in the language, neither blank."""
    return turns.filter(
        (F.col("turns") >= 2)
        & (F.col("language_0") == language)
        & (F.col("language_1") == language)
        & _spoken("text_0")
        & _spoken("text_1")
    )


def without_control_tokens(df: DataFrame, column: str, token: str = TURN_START) -> DataFrame:
    """B10."""
    return df.filter(~F.col(column).contains(token))


def within_token_limit(df: DataFrame, columns: Sequence[str], limit: int, counter=token_count, strict: bool = False) -> DataFrame:
    """Total tokens of some text columns at most (or, `strict`, below) a limit.

    `counter` maps a text column to a count; pass a pandas UDF to count with a model's tokenizer.
    """
    total = reduce(lambda a, b: a + b, [counter(F.col(name)) for name in columns])
    return df.filter(total < limit if strict else total <= limit)


def valid_metrics(results: DataFrame, column: str = "metric") -> DataFrame:
    """Rows with a measured metric (-1 means unmeasured)."""
    return results.filter(F.col(column) != -1)


def mapped_answers(rows: DataFrame, column: str = "chosen_position") -> DataFrame:
    """Rows whose answer has a position."""
    return rows.dropna(subset=[column])


def outcome_groups(results: DataFrame) -> DataFrame:
    """Clear outcomes only: `negative` lost every trial, `positive` won every trial."""
    wins, trials = F.col("wins"), F.col("trials")
    return results.withColumn(
        "outcome", F.when(wins == 0, "negative").when(wins == trials, "positive")
    ).filter(F.col("outcome").isNotNull())


def picked_only(df: DataFrame, column: str) -> DataFrame:
    """Rows that got a pick."""
    return df.filter(F.col(column).isNotNull())
