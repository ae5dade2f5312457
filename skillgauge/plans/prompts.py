"""Prompts of the profile-making analyses, ready for `inference.complete`.

Templates are the caller's; the fields each one may name are listed with the function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgauge.functions.text import fill_template, lines, replace_template, seeded_hash
from skillgauge.operators.filters import outcome_groups
from skillgauge.operators.indexing import chunks, numbered_listing, sample_rows, shuffled_index

# Instances per discovery prompt, instances of each kind in a contrast prompt.
CHUNK = 20
PER_OUTCOME = 50


def annotation_prompts(instances: DataFrame, template: str) -> DataFrame:
    """One prompt per instance from `input` and `output`."""
    return instances.select(
        "instance_id", fill_template(template, {"input": F.col("input"), "output": F.col("output")}).alias("prompt")
    )


def discovery_prompts(
    instances: DataFrame, template: str, names: tuple[str, str], size: int = CHUNK, seed: int = 0
) -> DataFrame:
    """Shuffled instances in chunks, each chunk listed in one prompt.

    Fields: `instance_num`, `inputs_and_outputs`.
    """
    grouped = chunks(shuffled_index(instances, seed, "instance_id"), size)
    listing = numbered_listing(grouped, ["chunk"], ["index"], [(names[0], "input"), (names[1], "output")])
    fields = {"instance_num": F.col("members"), "inputs_and_outputs": F.col("listing")}
    return listing.select("chunk", fill_template(template, fields).alias("prompt"))


def contrast_prompt(
    instances: DataFrame,
    results: DataFrame,
    template: str,
    names: tuple[str, str],
    negative: int = PER_OUTCOME,
    positive: int = PER_OUTCOME,
    capabilities: int = 20,
    seed: int = 0,
) -> DataFrame:
    """A seeded sample of clearly failed and clearly solved instances in one prompt.

    Fields: `negative_instance_num`, `negative_inputs_and_outputs`, the same for positive, and
    `capability_num`.
    """
    clear = outcome_groups(results).select("instance_id", "outcome")
    sides = [
        sample_rows(clear.filter(F.col("outcome") == outcome), n, seed, "instance_id")
        for outcome, n in (("negative", negative), ("positive", positive))
    ]
    picked = sides[0].unionByName(sides[1]).join(instances, "instance_id")
    order = seeded_hash(seed, F.col("instance_id"))
    parts = [(names[0], "input"), (names[1], "output")]
    listed = numbered_listing(picked, ["outcome"], [order], parts)

    def of(outcome: str, column: str):
        return F.max(F.when(F.col("outcome") == outcome, F.col(column)))

    both = listed.agg(
        *[F.coalesce(of(o, "members"), F.lit(0)).alias(f"{o}_instance_num") for o in ("negative", "positive")],
        *[F.coalesce(of(o, "listing"), F.lit("")).alias(f"{o}_inputs_and_outputs") for o in ("negative", "positive")],
    ).withColumn("capability_num", F.lit(capabilities))
    return both.select(fill_template(template, {name: F.col(name) for name in both.columns}).alias("prompt"))


def scoring_prompts(instances: DataFrame, capabilities: list[str], template: str) -> DataFrame:
    """H12, brace-safe: every instance with the numbered capability list.

    Fields: `num_capabilities`, `capability_list`, `input`, `output`.
    """
    listed = "\n".join(f"({i}) {capability}\n" for i, capability in enumerate(capabilities, start=1))
    fields = {
        "num_capabilities": F.lit(len(capabilities)),
        "capability_list": F.lit(listed),
        "input": F.col("input"),
        "output": F.col("output"),
    }
    return instances.select("instance_id", replace_template(template, fields).alias("prompt"))


def answer_lines(responses: DataFrame, order: str) -> DataFrame:
    """The capabilities of all responses as rows, in the order of their prompts."""
    return responses.select(order, F.posexplode(lines(F.col("response"))).alias("line", "capability"))
