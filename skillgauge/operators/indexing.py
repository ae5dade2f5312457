"""Seeded order, samples, chunks and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from skillgauge.functions.text import seeded_hash

# Hash buckets of a global numbering: 16^3 of them, numbered from one small table.
_BUCKET_DIGITS = 3
# Rows of a sample, or of its last bucket, that may meet in one task.
MERGED_ROWS = 100_000


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str, merge: int = MERGED_ROWS) -> DataFrame:
    """n rows in seeded order.

    Up to `merge` rows, each task keeps its own first n and these meet in one. A larger sample is cut by a
    histogram of hash prefixes: whole buckets before the cut are taken as they are, and only the bucket the cut falls into, itself
    cut down by further digits until it is small, is ranked. Both give the same rows.
    """
    order = seeded_hash(seed, *[F.col(k) for k in keys])
    if n <= merge:
        return df.orderBy(order, *keys).limit(n)
    hashed = df.withColumn("_hash", order)
    prefix, rest = _cut(hashed, n, merge)
    digits = len(prefix)
    if not digits:
        return df.orderBy(order, *keys)
    bucket = F.substring("_hash", 1, digits)
    ranked = hashed.filter(bucket == prefix).withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(prefix)).orderBy("_hash", *keys)))
    taken = hashed.filter(bucket < prefix).unionByName(ranked.filter(F.col("_rank") <= rest).drop("_rank"))
    return taken.orderBy("_hash", *keys).drop("_hash")


def _cut(hashed: DataFrame, n: int, merge: int) -> tuple[str, int]:
    """The hash prefix that the n-th row falls under, with at most `merge` rows, and how many of these are wanted.

    An empty prefix if there are no more than n rows. A pass counts 16^3 buckets at most.
    """
    prefix, rest = "", n
    while len(prefix) < 32:
        length = min(len(prefix) + _BUCKET_DIGITS, 32)
        inside = hashed.filter(F.col("_hash").startswith(prefix)) if prefix else hashed
        counts = sorted(inside.groupBy(F.substring("_hash", 1, length).alias("p")).agg(F.count("*").alias("n")).collect())
        if not prefix and sum(count for _, count in counts) <= n:
            break
        for prefix, count in counts:
            if rest <= count:
                break
            rest -= count
        if count <= merge:
            break
    return prefix, rest


def sample_per_group(df: DataFrame, n: int, seed: int, groups: Sequence[str], *keys: str) -> DataFrame:
    """at most n rows of each group; map tasks cut every group to n before the shuffle."""
    order = W.partitionBy(*groups).orderBy(seeded_hash(seed, *[F.col(k) for k in keys]), *keys)
    return df.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= n)


def train_eval_split(df: DataFrame, eval_size: int, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """F8: a seeded evaluation set of exact size and everything else for training."""
    held_out = sample_rows(df.select(*keys), eval_size, seed, *keys)
    return df.join(held_out, list(keys), "left_anti"), df.join(held_out, list(keys), "left_semi")


def shuffled_index(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A 0-based `index` in seeded order over the whole table.

    Rows are numbered inside hash buckets, which are even by construction, and each bucket starts
    where the ones before it end; only the bucket sizes meet in one place.
    """
    hashed = df.withColumn("_hash", seeded_hash(seed, *[F.col(k) for k in keys])).withColumn(
        "_bucket", F.substring("_hash", 1, _BUCKET_DIGITS)
    )
    return _numbered(hashed, "_bucket", ["_hash", *keys]).drop("_hash", "_bucket")


def dense_index(df: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """A 0-based `index` in the order of some columns; `bucket` is a coarse, monotone key of that order."""
    return _numbered(df.withColumn("_bucket", bucket), "_bucket", list(order)).drop("_bucket")


def _numbered(df: DataFrame, bucket: str, order: Sequence[str]) -> DataFrame:
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_size"))
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_row", inside).join(starts, bucket).withColumn(
        "index", F.col("_start") + F.col("_row") - 1
    ).drop("_row", "_start")


def chunks(indexed: DataFrame, size: int, index: str = "index") -> DataFrame:
    """Fixed-size chunks of a 0-based index."""
    return indexed.withColumn("chunk", F.floor(F.col(index) / size))


def numbered_listing(
    members: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: Sequence[tuple[str, str]]
) -> DataFrame:
    """One text per group that lists its members as `### Title #k` sections.

    `parts` are (title, column) pairs; a member shows one section per pair. A group is what one
    prompt holds.
    """
    order_columns = [column if isinstance(column, Column) else F.col(column) for column in order]
    member = F.struct(
        *[column.alias(f"o{i}") for i, column in enumerate(order_columns)],
        *[F.col(column).alias(f"t{i}") for i, (_, column) in enumerate(parts)],
    )

    def section(entry: Column, position: Column) -> Column:
        texts = [
            F.concat(F.lit(f"### {title} #"), (position + 1).cast("string"), F.lit("\n"), entry[f"t{i}"], F.lit("\n"))
            for i, (title, _) in enumerate(parts)
        ]
        return F.concat_ws("\n", *texts)

    return members.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("_members")).select(
        *keys,
        F.size("_members").alias("members"),
        F.array_join(F.transform("_members", section), "\n").alias("listing"),
    )
