"""Low-performing questions and their answers, all configurations in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skillgauge.functions.answers import answer_position
from skillgauge.operators.filters import drop_biased_orders, low_performers, mapped_answers
from skillgauge.operators.robustness import (
    CONFIGURATION,
    dedup_first,
    keep_low_rows,
    question_accuracy,
    question_robustness,
)
from skillgauge.session import broadcast_if_few, cut_lineage

# Columns that put the copies of one evaluation in a fixed order. The text columns come last, so the
# narrow part of the plan can leave them out.
COPY_ORDER = ["sample_index", "choices_order", "enumerator", "score"]
# The id comes first: it tells rows apart at once when they are sorted.
KEY = ["evaluation_id", *CONFIGURATION]
QUESTION = ["sample_index", *CONFIGURATION]


def _narrow(log: DataFrame, *extra) -> DataFrame:
    return log.select(*KEY, *COPY_ORDER, *extra)


def low_performing_questions(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every configuration's questions with a mean score under the threshold, with their text.

    Prompts are by far the widest column, so they are left out of both big shuffles: deduplication
    and averaging move only keys, scores and a flag. The texts of the few questions that remain are
    fetched afterwards by evaluation.
    """
    slim = _narrow(log, F.col("raw_input").isNotNull().alias("has_text"))
    clean = dedup_first(slim, KEY, COPY_ORDER + [F.desc("has_text")])
    scores = question_robustness(drop_biased_orders(clean), QUESTION)
    low = cut_lineage(low_performers(scores, threshold))
    return low.join(question_texts(log, low), QUESTION, "left").select(
        *CONFIGURATION, "sample_index", "average_score", "question"
    )


def question_texts(log: DataFrame, questions: DataFrame) -> DataFrame:
    """D1's text: the prompt of each question's first evaluation.

    With a small set of questions the log is filtered in place and no prompt is shuffled.
    """
    wanted = questions.select(*CONFIGURATION, F.col("first_evaluation").alias("evaluation_id")).dropna()
    candidates = (
        _narrow(log, "raw_input")
        .filter(F.col("raw_input").isNotNull())
        .join(broadcast_if_few(wanted), KEY, "left_semi")
    )
    first = dedup_first(candidates, KEY, [*COPY_ORDER, "raw_input"])
    return first.select(*CONFIGURATION, "sample_index", F.col("raw_input").alias("question"))


def low_performing_answers(log: DataFrame, threshold: float = 0.1, older_rules: bool = False) -> DataFrame:
    """The raw rows of low-performing questions with the choice position of their answer.

    Rows without a position are kept here; drop them with B13 before saving.
    """
    answers = log.select(*KEY, *COPY_ORDER, "closest_answer")
    clean = drop_biased_orders(dedup_first(answers, KEY, [*COPY_ORDER, "closest_answer"]))
    low = low_performers(question_accuracy(clean, QUESTION), threshold, "accuracy")
    return keep_low_rows(clean, low, QUESTION).withColumn(
        "chosen_position", answer_position(F.col("closest_answer"), older_rules)
    )


def saved_answers(log: DataFrame, threshold: float = 0.1, columns: Sequence[str] = ()) -> DataFrame:
    """I18 up to what is saved."""
    return mapped_answers(low_performing_answers(log, threshold)).select(*CONFIGURATION, "sample_index", *columns, "chosen_position")
