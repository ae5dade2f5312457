"""Batch model calls (J1-J3), their cost (D22), the annotation cache (A11, C10) and what is built on
them (I8, I9, I16).

A provider is a picklable callable of the caller: it takes a list of texts and returns a list of
dicts of the same length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from skillgauge.functions.metrics import LABELS
from skillgauge.functions.text import fill_template, lines, seeded_hash, strip
from skillgauge.operators.indexing import chunks, dense_index, numbered_listing, sample_per_group
from skillgauge.operators.tree import NODE, parent
from skillgauge.session import broadcast_if_few, cut_lineage, written

Provider = Callable[[list[str]], list[dict]]

# Price per million prompt and completion tokens, by model.
PRICES = [
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4o-2024-08-06", 2.5, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4o-mini-2024-07-18", 0.15, 0.6),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
]
# Examples per generated input, rows wanted per capability.
EXAMPLES_PER_INPUT = 5
ROWS_PER_CAPABILITY = 64
# Rows that one call of a provider holds at most, in bytes of their batch.
CALL_BYTES = 4 << 20


def _call(
    df: DataFrame, column: str, provider: Provider, fields: Sequence[T.StructField], attempts: int, tasks: int | None
) -> DataFrame:
    """Add the provider's answer fields and `failed` to each row, a slice of an Arrow batch at a time.

    Slices hold about `CALL_BYTES`, so that besides the batch itself a task holds little. A slice that keeps failing after
    `attempts` tries is tried row by row, so one bad row does not cost the others; rows that fail get nulls. Row order
    inside a partition stays.
    """
    schema = T.StructType([*df.schema.fields, *fields, T.StructField("failed", T.BooleanType())])
    kinds = {field.name: to_arrow_type(field.dataType) for field in fields}

    def attempt(texts: list[str]) -> list[dict] | None:
        for _ in range(attempts):
            try:
                answers = provider(texts)
                if len(answers) == len(texts):
                    return answers
            except Exception:  # the provider's errors are its own; the row is marked instead
                continue
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _slices(batch)):
            texts = part.column(column).to_pylist()
            answers = attempt(texts)
            if answers is None:
                answers = [(attempt([text]) or [None])[0] for text in texts]
            made = [pa.array([None if a is None else a.get(name) for a in answers], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*part.columns, *made, pa.array([a is None for a in answers], pa.bool_())], names=schema.names)

    source = df.repartition(tasks) if tasks else df
    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `CALL_BYTES`."""
    step = max(1, batch.num_rows * CALL_BYTES // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def complete(
    prompts: DataFrame, provider: Provider, column: str = "prompt", attempts: int = 3, tasks: int | None = None
) -> DataFrame:
    """`response`, `prompt_tokens`, `completion_tokens` and `failed` for each prompt row.

    `tasks` sets how many calls run side by side. Write or checkpoint the result before using it
    more than once, since Spark may otherwise call the model again.
    """
    fields = [
        T.StructField("response", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
    ]
    return _call(prompts, column, provider, fields, attempts, tasks)


_LEDGER = "digest string, response string, prompt_tokens bigint, completion_tokens bigint, error string"


def _asked(open_prompts: DataFrame, provider: Provider) -> DataFrame:
    """A ledger row for each open prompt (digest, prompt): its answer, or the error that it met."""

    def answered(texts: list[str]) -> list[tuple[dict | None, str | None]]:
        try:
            answers = provider(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
            return [(answer, None) for answer in answers]
        except Exception as error:  # the provider's errors are its own; they are written down
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            # One bad prompt does not cost the others.
            return [pair for text in texts for pair in answered([text])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = answered(list(batch["prompt"])) if len(batch) else []
            out = pd.DataFrame({"digest": batch["digest"]})
            for name in ("response", "prompt_tokens", "completion_tokens"):
                out[name] = pd.Series([None if a is None else a.get(name) for a, _ in pairs], index=batch.index, dtype=object)
            out["error"] = pd.Series([error for _, error in pairs], index=batch.index, dtype=object)
            yield out

    return open_prompts.mapInPandas(run, _LEDGER)


def complete_all(
    prompts: DataFrame,
    provider: Provider,
    ledger: str,
    column: str = "prompt",
    rounds: int = 8,
    wait: float = 1.0,
    tasks: int | None = None,
) -> DataFrame:
    """J1 until every prompt is answered: `response`, `prompt_tokens`, `completion_tokens`, `failed` and `error` for each row.

    `ledger` is a folder that all executors reach. A round asks about the distinct prompts without an answer there and writes
    down what it gets, answers and errors; the next one, after a pause that doubles, asks about what is still open. So a prompt is
    answered once however many rows hold it, a lost executor costs the calls of its unfinished tasks only, and a job
    that is started again goes on where the ledger ends. After `rounds` rounds the open rows have nulls, `failed` and the
    last error. Null prompts are not asked about and are not failures.
    """
    spark = prompts.sparkSession
    digest = F.sha2(F.col(f"`{column}`").cast("binary"), 256)
    distinct = prompts.filter(F.col(f"`{column}`").isNotNull()).select(digest.alias("digest"), F.col(f"`{column}`").alias("prompt")).dropDuplicates(["digest"])

    def entries() -> DataFrame:
        try:
            return spark.read.schema(_LEDGER + ", round int").parquet(ledger)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _LEDGER + ", round int")

    first = (entries().agg(F.max("round")).first()[0] or 0) + 1
    for turn in range(rounds):
        left = distinct.join(entries().filter("error IS NULL").select("digest"), "digest", "left_anti")
        left = cut_lineage(left.repartition(tasks) if tasks else left)
        if left.isEmpty():
            break
        if turn:
            time.sleep(wait * 2 ** (turn - 1))
        _asked(left, provider).write.parquet(f"{ledger}/round={first + turn}")
    latest = F.struct(F.col("error").isNull().alias("answered"), "round", "response", "prompt_tokens", "completion_tokens", "error")
    best = entries().groupBy("digest").agg(F.max(latest).alias("_entry"))
    joined = prompts.withColumn("_digest", digest).join(best, F.col("_digest") == F.col("digest"), "left")
    answer = [F.col(f"_entry.{name}").alias(name) for name in ("response", "prompt_tokens", "completion_tokens")]
    failed = F.col("_digest").isNotNull() & ~F.coalesce(F.col("_entry.answered"), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in prompts.columns], *answer, failed.alias("failed"), F.col("_entry.error").alias("error"))


def embed(texts: DataFrame, provider: Provider, column: str = "text", attempts: int = 3, tasks: int | None = None) -> DataFrame:
    """`embedding ARRAY<FLOAT>` and `prompt_tokens` for each text row."""
    fields = [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("prompt_tokens", T.LongType()),
    ]
    return _call(texts, column, provider, fields, attempts, tasks)


def moderate(texts: DataFrame, provider: Provider, column: str = "text", attempts: int = 1, tasks: int | None = None) -> DataFrame:
    """`moderation STRUCT<flagged, score>` for each text row, null on failure."""
    verdict = T.StructType([T.StructField("flagged", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return _call(texts, column, provider, [T.StructField("moderation", verdict)], attempts, tasks).drop("failed")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double")


def usage_cost(usage: DataFrame, prices: DataFrame | None = None, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cost of `prompt_tokens` and `completion_tokens` at each model's price; unknown models get null."""
    table = F.broadcast(price_table(usage.sparkSession)) if prices is None else prices
    tokens = usage.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    cost = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    return tokens.join(table, "model", "left").select(
        *keys, "prompt_tokens", "completion_tokens", (cost / F.lit(1e6)).alias("cost")
    )


def missing_annotations(capabilities: DataFrame, instances: DataFrame, cache: DataFrame) -> DataFrame:
    """Capability and instance pairs without a usable label yet.

    The capabilities of a profile are a short list. Each instance is compared with the labels it
    already has as one set, so the full grid of pairs is never built only to be thrown away.
    """
    wanted = capabilities.agg(F.array_sort(F.collect_set("capability")).alias("_wanted")).scalar()
    known = (
        cache.filter(F.col("label").isin(LABELS))
        .join(capabilities.select("capability").distinct(), "capability", "left_semi")
        .groupBy("instance_id")
        .agg(F.collect_set("capability").alias("_known"))
    )
    return (
        instances.select("instance_id")
        .distinct()
        .join(known, "instance_id", "left")
        .select(
            F.explode(F.array_except(wanted, F.coalesce("_known", F.array().cast("array<string>")))).alias("capability"),
            "instance_id",
        )
    )


def annotate(
    capabilities: DataFrame, instances: DataFrame, cache: DataFrame, template: str, provider: Provider, tasks: int | None = None
) -> DataFrame:
    """The cache with every missing label of these capabilities and instances filled by the provider.

    `instances` has `instance_id`, `input`, `output`. The result is the next version of the cache;
    write it beside the old one.
    """
    cache = written(cache.select("capability", "instance_id", "label"), "cache")
    missing = missing_annotations(capabilities, instances, cache)
    prompts = missing.join(instances.select("instance_id", "input", "output"), "instance_id").select(
        "capability",
        "instance_id",
        fill_template(template, {name: F.col(name) for name in ("input", "output", "capability")}).alias("prompt"),
    )
    answers = written(complete(prompts, provider, tasks=tasks).select("capability", "instance_id", F.col("response").alias("label")), "answers")
    # A usable label is never asked for again; only the others, few as a rule, are looked up among the answers.
    usable = F.coalesce(F.col("label").isin(LABELS), F.lit(False))
    doubtful = cut_lineage(cache.filter(~usable))
    keys = ["capability", "instance_id"]
    answered = answers.select(*keys).join(broadcast_if_few(doubtful.select(*keys)), keys, "left_semi")
    return cache.filter(usable).unionByName(doubtful.join(answered, keys, "left_anti").select(*cache.columns)).unionByName(answers)


def describe_nodes(
    leaves: DataFrame, template: str, provider: Provider, seed: int = 42, title: str = "Skill"
) -> DataFrame:
    """I8: a description of every inner node, from its children's texts, bottom up.

    `leaves` has `tree_id`, `path`, `instance_id`, `text`. One round per depth; a round makes one
    prompt per node from the children in seeded order and calls the provider once per node.
    """
    deepest = leaves.agg(F.max(F.size("path"))).first()[0]
    below: DataFrame | None = None
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        children = leaves.filter(F.size("path") == depth).select(
            *NODE, F.col("instance_id").cast("string").alias("member"), "text"
        )
        if below is not None:
            children = children.unionByName(
                below.select(
                    "tree_id",
                    parent(F.col("path")).alias("path"),
                    F.concat(F.lit("node "), F.element_at("path", -1).cast("string")).alias("member"),
                    F.col("description").alias("text"),
                )
            )
        groups = numbered_listing(children, NODE, [seeded_hash(seed, F.col("member")), "member"], [(title, "text")])
        prompts = groups.withColumn(
            "prompt",
            fill_template(template, {"group_number": F.col("members"), "skill_descriptions": F.col("listing")}),
        ).select(*NODE, "members", "prompt")
        below = cut_lineage(
            complete(prompts, provider).select(*NODE, "members", strip(F.col("response")).alias("description"))
        )
        levels.append(below)
    described = levels[0]
    for level in levels[1:]:
        described = described.unionByName(level)
    return described


def shrink_round(
    capabilities: DataFrame, template: str, provider: Provider, wanted: int = 20, factor: int = 4
) -> DataFrame:
    """I9, one round: chunks of `wanted * factor` capabilities become at most a short list each.

    `capabilities` has a dense 0-based `index` and `capability`. A chunk of `wanted` or fewer passes
    through; any other is sent to the provider, whose answer is read line by line.
    """
    grouped = (
        chunks(capabilities, wanted * factor)
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("index", "capability"))).alias("_members"))
        .withColumn("_texts", F.transform("_members", lambda m: m["capability"]))
    )
    short = grouped.filter(F.size("_texts") <= wanted).select("chunk", F.posexplode("_texts").alias("line", "capability"))
    listing = F.array_join(
        F.transform(
            "_texts", lambda text, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), text, F.lit("\n"))
        ),
        "\n",
    )
    prompts = grouped.filter(F.size("_texts") > wanted).select(
        "chunk",
        fill_template(
            template,
            {
                "current_num_capabilities": F.size("_texts"),
                "num_capabilities": F.lit(wanted),
                "capability_list": listing,
            },
        ).alias("prompt"),
    )
    shrunk = complete(prompts, provider).select("chunk", F.posexplode(lines(F.col("response"))).alias("line", "capability"))
    rows = short.unionByName(shrunk)
    return dense_index(rows, F.floor(F.col("chunk") / 1000), "chunk", "line").select("index", "capability")


def shrink_capabilities(
    capabilities: DataFrame, template: str, provider: Provider, wanted: int = 20, factor: int = 4
) -> DataFrame:
    """Rounds until at most `wanted` capabilities are left; a round that leaves as many as before is an error."""
    current = cut_lineage(capabilities.select("index", "capability"))
    left = current.count()
    while left > wanted:
        current = cut_lineage(shrink_round(current, template, provider, wanted, factor))
        before, left = left, current.count()
        if left >= before:
            raise RuntimeError(f"a round left {left} of {before} capabilities; {wanted} are wanted")
    return current


def example_prompts(
    members: DataFrame,
    cached: DataFrame,
    template: str,
    title: str = "Question",
    per_prompt: int = EXAMPLES_PER_INPUT,
    wanted: int = ROWS_PER_CAPABILITY,
    seed: int = 0,
) -> DataFrame:
    """I16, C14: the prompts that fill every capability up to `wanted` generated inputs.

    `members` has `capability`, `instance_id`, `input`; `cached` one row per input generated so far.
    Draw d of a capability takes the next `per_prompt` of its instances in seeded order, starting over
    at the end, so it never needs more than `wanted * per_prompt` of them. Draws are numbered after
    the inputs there are, so that a top-up does not repeat the prompts already answered.
    """
    have = cached.groupBy("capability").agg(F.count("*").alias("_have"))
    pool = sample_per_group(members, wanted * per_prompt, seed, ["capability"], "instance_id")
    sizes = pool.groupBy("capability").agg(F.count("*").alias("_pool"))
    draws = (
        sizes.join(have, "capability", "left")
        .withColumn("_next", (F.coalesce("_have", F.lit(0)) + 1).cast("int"))
        .filter(F.col("_next") <= wanted)
        .withColumn("draw", F.explode(F.sequence(F.col("_next"), F.lit(wanted))))
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_prompt), "_pool").cast("int") - 1)))
        .withColumn("sample_rank", ((F.col("draw") - 1) * per_prompt + F.col("_slot")) % F.col("_pool") + 1)
        .select("capability", "draw", F.col("sample_rank").cast("int").alias("sample_rank"))
    )
    examples = draws.join(pool.select("capability", "sample_rank", "input"), ["capability", "sample_rank"])
    order = seeded_hash(seed, F.col("draw"), F.col("sample_rank"))
    return numbered_listing(examples, ["capability", "draw"], [order], [(title, "input")]).select(
        "capability",
        "draw",
        fill_template(
            template,
            {
                "capability": F.col("capability"),
                "instance_num": F.col("members"),
                "example_inputs": F.col("listing"),
            },
        ).alias("prompt"),
    )
