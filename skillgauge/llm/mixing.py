"""Mixing sources to target weights by hash order and distributed prefix sums (operator 9).

Every document gets a hash-random key. Inside a source the keys are cut into even ranges; the sizes
of the ranges are summed, and a document's prefix is the sum of the ranges before its own plus the
sum before it inside its range. A source takes whole epochs first and then documents in key order
up to its exact budget, the last one in part.

Defined results: null and blank texts have size 0 and take nothing; a null source is a source, the
last one; equal keys are ordered by id and size, rows that are equal in those are interchangeable;
an empty table gives an empty table; other input columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skillgauge.llm.columns import words
from skillgauge.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Rows in one key range of a source, on average.
RANGE_ROWS = 20_000


def hash_key(seed: int, key: Column) -> Column:
    """32 hexadecimal digits, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, epochs: int = 2) -> DataFrame:
    """source, source_size, n_docs -> the same with `target`.

    Sources share the total by weight; none gets more than `epochs` times its size, and what it
    cannot take goes to the others by weight. Filling sources in the order of size per weight gives
    this in one pass: source k is full if its cap is below its share of what the fuller ones leave.
    There is one row per source here.
    """
    names = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__n") - 1) % len(weights) + 1)
    ranked = sizes.withColumn("__n", names).withColumn("__w", weight.cast("long"))
    everything = W.partitionBy()
    before = W.orderBy((epochs * F.col("source_size") / F.col("__w")), "__n").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("__w").over(everything))
        .withColumn("__full", F.coalesce(F.sum(epochs * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("__used", F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__left", share_percent * F.col("__all") - 100 * F.col("__full"))
        .withColumn("__rest", 100 * (F.col("__weights") - F.col("__used")))
        # Whole numbers until the one division, so that every engine gets the same doubles.
        .withColumn("__open", F.col("__left") * F.col("__w") < epochs * F.col("source_size") * F.col("__rest"))
    )
    first_open = F.min(F.when(F.col("__open"), F.struct("__used", "__left", "__rest"))).over(everything)
    level = filled.withColumn("__level", first_open)
    share = F.col("__w") * F.col("__level.__left") / F.col("__level.__rest")
    full = F.col("__level").isNull() | (F.col("__used") < F.col("__level.__used"))
    return level.select(
        "source",
        "source_size",
        "n_docs",
        F.when(full, epochs * F.col("source_size").cast("double")).otherwise(share.cast("double")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = 150,
    epochs: int = 2,
    seed: int = 42,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes."""
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        *carry,
    )
    # Four narrow columns, read three times below: written once instead of splitting every text again.
    sized = cut_lineage(sized).withColumn("__key", hash_key(seed, F.col("doc_id")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sources, weights, share_percent, epochs)

    draw = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        sized["*"], "source_size", "target", F.floor(draw * ranges / 2**32).alias("__range")
    )
    sums = placed.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    earlier = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    same = placed["source"].eqNullSafe(starts["source"]) & (placed["__range"] == starts["__range"])
    inside = W.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    prefixed = placed.join(starts, same).select(placed["*"], "__start").withColumn(
        "__before", F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    part = budget - whole * F.col("source_size") - F.col("__before")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))
    return prefixed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with `epoch` (from 1) and `take_words`, how many of its words that epoch uses.

    Rows with the same id, text and source are one document here: it stands once in every epoch that takes it
    and uses the words of its rows together. Where such rows differ in other columns, the one with the smallest hash
    of all columns stands for them.
    """
    id_column, text, source = (options.get(name, usual) for name, usual in (("id_column", "doc_id"), ("text", "text"), ("source", "source")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.xxhash64(F.col(f"`{text}`"))
    marked = docs.select(
        F.struct(*columns).alias("__row"), F.col(f"`{id_column}`").alias("__id"), F.col(f"`{source}`").alias("__source"), digest.alias("__digest"), F.xxhash64(*columns).alias("__all")
    )
    one = W.partitionBy("__id", "__source", "__digest").orderBy("__all")
    single = marked.withColumn("__copy", F.row_number().over(one)).filter(F.col("__copy") == 1)

    plan = mix_sources(docs.withColumn("__digest", digest), carry=["__digest"], **options)
    wanted = plan.groupBy("doc_id", "source", "__digest").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    wanted = wanted.filter(F.col("taken") > 0)
    epochs = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    copies = wanted.withColumn("epoch", epochs).select(
        F.col("doc_id").alias("__wanted"),
        F.col("source").alias("__wanted_source"),
        F.col("__digest").alias("__wanted_digest"),
        "epoch",
        F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).alias("take_words"),
    )
    same = single["__id"].eqNullSafe(copies["__wanted"]) & single["__source"].eqNullSafe(copies["__wanted_source"])
    joined = single.join(copies, same & (single["__digest"] == copies["__wanted_digest"]))
    own = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("epoch", "take_words")]
    return joined.select(*own, "epoch", "take_words")
