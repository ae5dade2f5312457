"""Instruction corpora (E2, E7, C13, I13, I14) and training sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from skillgauge.functions.text import first_message_key, fix_output
from skillgauge.operators.filters import (
    language_tagged_dialogues,
    picked_only,
    role_tagged_dialogues,
    within_token_limit,
    without_control_tokens,
)
from skillgauge.operators.indexing import sample_rows

# Fixed value: token limit of the first two turns.
TOKEN_LIMIT = 4096
# Fixed value: label of tokens that carry no loss.
IGNORED = -100

# Models whose answer is taken, best first.
MODEL_PREFERENCE = [
    "gpt-4-1106-preview", "gpt-4-0125-preview", "gpt-4-0314", "gpt-4-0613", "qwen1.5-72b-chat", "mistral-medium",
    "claude-1", "gemini-pro-dev-api", "claude-2.0", "gemini-pro", "mixtral-8x7b-instruct-v0.1", "yi-34b-chat",
    "gpt-3.5-turbo-0613", "starling-lm-7b-alpha", "wizardlm-70b", "llama-2-70b-chat", "claude-2.1",
    "nous-hermes-2-mixtral-8x7b-dpo", "gpt-3.5-turbo-0125", "gpt-3.5-turbo-0314", "claude-instant-1",
    "pplx-70b-online", "vicuna-33b", "tulu-2-dpo-70b", "solar-10.7b-instruct-v1.0", "llama2-70b-steerlm-chat",
    "deepseek-llm-67b-chat", "openchat-3.5", "openhermes-2.5-mistral-7b", "mistral-7b-instruct-v0.2",
    "dolphin-2.2.1-mistral-7b", "wizardlm-13b", "openchat-3.5-0106", "gpt-3.5-turbo-1106", "qwen1.5-7b-chat",
    "codellama-34b-instruct", "llama-2-13b-chat", "zephyr-7b-beta", "llama-2-7b-chat", "pplx-7b-online",
    "guanaco-33b", "zephyr-7b-alpha", "mpt-30b-chat", "vicuna-13b", "stripedhyena-nous-7b", "falcon-180b-chat",
    "qwen-14b-chat", "palm-2", "mistral-7b-instruct", "qwen1.5-4b-chat", "vicuna-7b", "koala-13b", "chatglm3-6b",
    "gpt4all-13b-snoozy", "mpt-7b-chat", "chatglm2-6b", "RWKV-4-Raven-14B", "alpaca-13b", "oasst-pythia-12b",
    "fastchat-t5-3b", "chatglm-6b", "stablelm-tuned-alpha-7b", "dolly-v2-12b", "llama-13b",
]


def dedup_first_messages(
    dialogues: DataFrame, identity: str, position: str, text: str = "text_0", length: int | None = None
) -> DataFrame:
    """Of all conversations with the same first message keep those with the last one's id.

    The message is compared by digest, so the owner of each key is found from ids alone; a message
    that a third of all conversations share is one map-side maximum. The texts move once, spread by
    key and id.
    """
    keyed = dialogues.withColumn("_key", F.sha2(first_message_key(F.col(text), length), 256))
    owners = keyed.groupBy("_key").agg(F.max_by(identity, position).alias(identity))
    return keyed.join(owners, ["_key", identity], "left_semi").drop("_key")


def instruction_corpus(
    dialogues: DataFrame,
    identity: str,
    tagged_by: str = "role",
    size: int | None = None,
    sample_first: int | None = None,
    key_length: int | None = None,
    token_limit: int = TOKEN_LIMIT,
    seed: int = 42,
    counter: Callable[[Column], Column] | None = None,
    **speakers: str,
) -> DataFrame:
    """Cleaned, deduplicated instruction and response pairs: all, or `size` of them in seeded order.

    `dialogues` has one row per conversation; `tagged_by` says whether turns carry a role or a
    language. A source can be sampled first, and compared by the start of the first message only.
    Samples are chosen by id alone; the texts join in for those that stay.
    """
    source = _sampled(dialogues, sample_first, seed, identity)
    valid = role_tagged_dialogues if tagged_by == "role" else language_tagged_dialogues
    kept = valid(source, **speakers)
    extra = {} if counter is None else {"counter": counter}
    kept = within_token_limit(kept, ["text_0", "text_1"], token_limit, **extra)
    kept = dedup_first_messages(kept, identity, identity, length=key_length)
    return _sampled(kept, size, seed, identity).select(
        identity, F.col("text_0").alias("instruction"), F.col("text_1").alias("response")
    )


def _sampled(rows: DataFrame, n: int | None, seed: int, identity: str) -> DataFrame:
    return rows if n is None else rows.join(sample_rows(rows.select(identity), n, seed, identity), identity, "left_semi")


def answers_by_side(battles: DataFrame, position: str = "battle_id") -> DataFrame:
    """One row per battle and side, with a number that grows in reading order (side a before b)."""
    sides = F.array(
        F.struct(F.col("model_a").alias("model"), F.col("answer_a").alias("answer"), F.lit(0).alias("side")),
        F.struct(F.col("model_b").alias("model"), F.col("answer_b").alias("answer"), F.lit(1).alias("side")),
    )
    return battles.select("question", position, F.inline(sides)).withColumn(
        "read_order", F.col(position) * 2 + F.col("side")
    )


def last_answers(battles: DataFrame, position: str = "battle_id") -> DataFrame:
    """The last answer of each model to each question.

    Chosen by digest and reading order; the texts join in once.
    """
    sides = answers_by_side(battles, position)
    last = sides.groupBy(F.sha2("question", 256).alias("_key"), "model").agg(F.max("read_order").alias("read_order"))
    return sides.join(last.select("read_order"), "read_order", "left_semi").select("question", "model", "answer")


def model_ranks(spark: SparkSession, models: Sequence[str] = tuple(MODEL_PREFERENCE)) -> DataFrame:
    return spark.createDataFrame(list(enumerate(models)), "rank int, model string")


def preferred_answers(answers: DataFrame, models: Sequence[str] = tuple(MODEL_PREFERENCE)) -> DataFrame:
    """Per question the answer of the first listed model that gave one.

    `answers` has one row per question and model. The best rank is found by digest; the texts join in once.
    """
    ranked = answers.join(F.broadcast(model_ranks(answers.sparkSession, models)), "model").withColumn("_key", F.sha2("question", 256))
    best = ranked.groupBy("_key").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["_key", "rank"], "left_semi").select("question", F.col("answer").alias("response"))


def arena_corpus(
    battles: DataFrame, models: Sequence[str] = tuple(MODEL_PREFERENCE), position: str = "battle_id"
) -> DataFrame:
    """One response per question, from the preferred model's last answer.

    Same result as B10, E7 and C13 one after another. The choice is made on digests and numbers; the
    answer texts join in at the end, once.
    """
    ranks = F.broadcast(model_ranks(battles.sparkSession, models))
    sides = answers_by_side(without_control_tokens(battles, "question"), position)
    chosen = (
        sides.select(F.sha2("question", 256).alias("_key"), "model", "read_order")
        .join(ranks, "model")
        .groupBy("_key", "rank")
        .agg(F.max("read_order").alias("read_order"))
        .groupBy("_key")
        .agg(F.min_by("read_order", "rank").alias("read_order"))
    )
    return picked_only(
        sides.join(chosen.select("read_order"), "read_order", "left_semi").select(
            F.col("question").alias("instruction"), F.col("answer").alias("response")
        ),
        "response",
    )


def lookup_outputs(inputs: DataFrame, outputs: DataFrame, strict: bool = True) -> DataFrame:
    """Inputs with their output; with `strict` a missing output is an error."""
    if strict:
        missing = inputs.join(outputs, "input", "left_anti").limit(1).count()
        if missing:
            raise ValueError("an input has no output")
    return inputs.join(outputs.select("input", "output"), "input")


def training_set(
    pools: DataFrame, capabilities: DataFrame, outputs: DataFrame, dataset: str, size: int = 128, seed: int = 0
) -> DataFrame:
    """A seeded sample of the inputs generated for some capabilities, with their outputs.

    `pools` has `capability` and `inputs ARRAY<STRING>`.
    """
    inputs = (
        pools.join(capabilities.select("capability").distinct(), "capability", "left_semi")
        .select("capability", F.posexplode("inputs").alias("position", "input"))
    )
    sampled = sample_rows(inputs, size, seed, "capability", "position")
    joined = lookup_outputs(sampled, outputs)
    return joined.select(
        "capability", "position", "input", fix_output(F.col("output"), F.lit(dataset)).alias("output")
    )


def capability_inputs(capabilities: DataFrame, inputs: DataFrame) -> DataFrame:
    """C14: capabilities with the input of each of their instances."""
    return capabilities.select("capability", F.explode("instances").alias("instance_id")).join(inputs, "instance_id")


def masked_labels(tokens: Column, source_length: Column) -> Column:
    """Labels of a training row; the tokens of its source carry no loss."""
    return F.transform(tokens, lambda token, i: F.when(i < source_length, F.lit(IGNORED)).otherwise(token))


def padded_batches(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Tokens and labels filled up to the longest row of their batch, with the attention mask."""
    longest = F.max(F.size("tokens")).over(W.partitionBy(batch))
    fill = F.col("_longest") - F.size("tokens")
    padded = rows.withColumn("_longest", longest).withColumns(
        {
            "tokens": F.concat("tokens", F.array_repeat(F.lit(pad), fill)),
            "labels": F.concat("labels", F.array_repeat(F.lit(IGNORED), fill)),
        }
    )
    return padded.withColumn("attention_mask", F.transform("tokens", lambda token: (token != pad).cast("int"))).drop(
        "_longest"
    )
