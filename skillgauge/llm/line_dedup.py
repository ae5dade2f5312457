"""Line dedup by a suffix array over line sequences (operator 1).

Each document is the sequence of its lines that hold a word. All suffixes of all sequences are ranked
by their first line, and prefix doubling refines the ranks: the rank of a suffix by its first 2h lines
follows from its own rank and the rank of the suffix h lines on, both by h lines. A rank is the number
of smaller suffixes, so suffixes that share their first h lines share a rank: such a group is an
interval of the suffix array whose longest common prefix is h or more. Doubling goes on until the
prefixes are `min_lines` long, since deeper ranks only sort inside intervals that are known by then,
and it leaves out documents in which no suffix shares its rank. A prefix counts if it is `min_lines`
long or if it is shorter and holds `min_words` words or more; without `min_words` only the lines
count. The first suffix of an interval, by document and position, is the original; every other one is
a later copy, and the lines of its prefix are deleted. Prefixes that overlap or touch add up to the
maximal repeated runs.

Ranks inside one group are prefix sums over ranges of the next rank, so a line that a third of all
documents hold is never sorted in one task.

Defined results: null texts have no lines; blank lines belong to no sequence and stay; lines are equal
if their bytes are; documents are ordered by id, nulls first, and by a digest of the text; rows with
the same id and text are one document and lose the same lines; a run that overlaps its own copy keeps
its first line; an empty table gives an empty table; other input columns are kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skillgauge.llm.columns import SPACE, settled, words
from skillgauge.llm.storage import broadcast_if_small, stored

MIN_LINES = 3
#: Words from which a repeated run of fewer lines counts as well, where callers ask for it.
MIN_WORDS = 50
#: Hash ranges of the first ranking, and ranges of the next rank inside a group.
RANGES = 1024


def _document_key(id_column: str, text: str) -> Column:
    return F.struct(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("digest"))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")


def _worded(lines: str) -> Column:
    """0-based numbers of the lines that hold a word."""
    return F.filter(
        F.transform(lines, lambda line, i: F.when(line.rlike(f"[^{SPACE}]"), i)), lambda i: i.isNotNull()
    )


def line_sequences(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, at (0-based position in the sequence), line (digest of its bytes), words (how many it holds)."""
    split = docs.select(_document_key(id_column, text).alias("doc"), _lines(text).alias("lines"))
    kept = F.filter("lines", lambda line: line.rlike(f"[^{SPACE}]"))
    each = split.select("doc", F.posexplode_outer(kept).alias("at", "text")).filter(F.col("at").isNotNull())
    return each.select("doc", "at", F.unhex(F.md5("text")).alias("line"), F.size(words(F.col("text"))).alias("words")).distinct()


def first_ranks(lines: DataFrame) -> DataFrame:
    """doc, at, words, rank (suffixes with a smaller first line), group (suffixes with the same one)."""
    counts = lines.groupBy("line").agg(F.count("*").alias("group"))
    # Digests are even, so their first bits cut them into even ranges.
    counts = counts.withColumn("range", F.conv(F.hex(F.substring("line", 1, 2)), 16, 10).cast("int") % F.lit(65536))
    ranked = _prefix_ranks(counts, [], "range", "line", "group")
    return lines.join(ranked.select("line", "rank", "group"), "line").select("doc", "at", "words", "rank", "group")


def _prefix_ranks(counts: DataFrame, keys: list[str], part: str, order: str, size: str) -> DataFrame:
    """`rank`: the sum of `size` over smaller `order` inside the keys; `part` is a coarse monotone key of that order."""
    sums = counts.groupBy(*keys, part).agg(F.sum(size).alias("__sum"))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*keys, part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        counts.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(starts, [*keys, part])
        .withColumn("rank", F.col("__start") + F.col("__inside"))
        .drop("__start", "__inside")
    )


def _with_next(ranks: DataFrame, step: int) -> DataFrame:
    """Adds `next`, the rank of the suffix `step` lines on, or -1 past the end of the document."""
    return ranks.withColumn("next", F.coalesce(F.lead("rank", step).over(W.partitionBy("doc").orderBy("at")), F.lit(-1).cast("long")))


def double(ranks: DataFrame, step: int, suffixes: int) -> DataFrame:
    """Ranks by `step` lines -> ranks by 2 * `step` lines. Singletons keep their rank."""
    paired = _with_next(ranks, step)
    open_rows = paired.filter(F.col("group") > 1)
    pairs = open_rows.groupBy(F.col("rank").alias("old"), "next").agg(F.count("*").alias("group"))
    width = max(1, -(-suffixes // RANGES))
    pairs = pairs.withColumn("range", F.floor((F.col("next") + 1) / width))
    finer = _prefix_ranks(pairs, ["old"], "range", "next", "group").select(
        "old", F.col("next").alias("then"), (F.col("old") + F.col("rank")).alias("finer"), F.col("group").alias("members")
    )
    refined = open_rows.join(finer, (open_rows["rank"] == finer["old"]) & (open_rows["next"] == finer["then"])).select(
        "doc", "at", "words", F.col("finer").alias("rank"), F.col("members").alias("group")
    )
    return refined.unionByName(paired.filter(F.col("group") == 1).select("doc", "at", "words", "rank", "group"))


def _candidates(ranks: DataFrame, step: int, lengths: range, min_lines: int, min_words: int | None) -> DataFrame:
    """n_lines, rank, next, place: windows of these lengths that count, from `ranks` by `step` lines, if their first lines repeat.

    A window is its first `step` lines and its last `step` lines; all its lines are there.
    """
    place = W.partitionBy("doc").orderBy("at")
    windows = []
    for length in lengths:
        following = F.coalesce(F.lead("rank", length - step).over(place), F.lit(-1).cast("long")) if length > step else F.col("rank")
        counts = F.lead("rank", length - 1).over(place).isNotNull() if length > 1 else F.lit(True)
        if length < min_lines:
            counts &= (F.sum("words").over(place.rowsBetween(0, length - 1)) if length > 1 else F.col("words")) >= min_words
        windows.append(F.when(counts, F.struct(F.lit(length).alias("n_lines"), following.alias("next"))))
    rows = ranks.select("rank", "group", F.struct("doc", "at").alias("place"), F.array(*windows).alias("windows")).filter("group > 1")
    each = rows.select("rank", "place", F.explode("windows").alias("window")).filter(F.col("window").isNotNull())
    return each.select("window.n_lines", "rank", "window.next", "place")


def repeated_windows(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", min_words: int | None = None
) -> DataFrame:
    """doc, at, n_lines, source, source_at: windows that are later copies, and their original.

    Windows are `min_lines` long, or shorter with `min_words` words or more.
    """
    lines = stored(line_sequences(docs, id_column, text), "lines")
    ranks = first_ranks(lines)
    shared = ranks.filter(F.col("group") > 1).select(F.col("doc").alias("__doc")).distinct()
    # Only documents with a line that stands elsewhere too; ranks stay those of the whole suffix array.
    ranks = stored(ranks.join(shared, ranks["doc"] == shared["__doc"], "left_semi"), "ranks")
    suffixes = (ranks.agg(F.max("rank").alias("n")).first()["n"] or 0) + 1
    step, parts = 1, []
    while True:
        last = 2 * step > min_lines
        lengths = range(step if min_words is not None else min_lines, min_lines + 1 if last else 2 * step)
        if lengths:
            parts.append(_candidates(ranks, step, lengths, min_lines, min_words))
        if last:
            break
        ranks = stored(double(ranks, step, suffixes), "ranks")
        step *= 2
    windows = functools.reduce(DataFrame.unionByName, parts)
    originals = (
        windows.groupBy("n_lines", "rank", "next")
        .agg(F.min("place").alias("original"), F.max("place").alias("last"))
        .filter(F.col("original") != F.col("last"))
        .drop("last")
    )
    copies = windows.join(originals, ["n_lines", "rank", "next"]).filter(F.col("place") != F.col("original"))
    return copies.select(
        F.col("place.doc").alias("doc"),
        F.col("place.at").alias("at"),
        "n_lines",
        F.col("original.doc").alias("source"),
        F.col("original.at").alias("source_at"),
    )


def repeated_runs(windows: DataFrame) -> DataFrame:
    """Chains windows that continue each other in copy and original: doc, start, n_lines, source, source_start."""
    chain = F.struct("source", (F.col("at") - F.col("source_at")).alias("offset"))
    rows = windows.withColumns({"__chain": chain, "__end": F.col("at") + F.col("n_lines")})
    place = W.partitionBy("doc", "__chain").orderBy("at")
    before = F.max("__end").over(place.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__first", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__first").over(place.rowsBetween(W.unboundedPreceding, 0)))
    return (
        rows.groupBy("doc", "__chain", "__island")
        .agg(F.min("at").alias("start"), (F.max("__end") - F.min("at")).alias("n_lines"), F.first("source").alias("source"), F.min("source_at").alias("source_start"))
        .drop("__chain", "__island")
    )


def removed_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", min_words: int | None = None
) -> DataFrame:
    """doc, windows (position and n_lines of its windows that are later copies, sorted); documents without one are absent."""
    windows = repeated_windows(docs, min_lines, id_column, text, min_words)
    return windows.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("at", "n_lines"))).alias("windows"))


def _trimmed(docs: DataFrame, min_lines: int, id_column: str, text: str, min_words: int | None) -> DataFrame:
    """`docs` with __lines (all), __worded, __gone (numbers of the lines to delete) and __windows."""
    removed = stored(removed_lines(docs, min_lines, id_column, text, min_words), "removed").withColumnRenamed("windows", "__windows")
    removed = broadcast_if_small(removed, 40 + 24 * F.size("__windows")).withColumnRenamed("doc", "__doc")
    key = _document_key(id_column, text)
    joined = docs.join(removed, key == removed["__doc"], "left").drop("__doc")
    joined = joined.withColumn("__lines", _lines(text)).withColumn("__worded", _worded("__lines"))
    inside = F.flatten(F.transform("__windows", lambda window: F.slice("__worded", window["at"] + 1, window["n_lines"])))
    return joined.withColumn("__gone", F.coalesce(F.array_distinct(inside), F.array().cast("array<int>")))


def _kept_text(lines: str, gone: str) -> Column:
    numbers = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1))
    return F.array_join(F.transform(F.array_except(numbers, F.col(gone)), lambda i: F.get(F.col(lines), i)), "\n")


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", min_words: int | None = None
) -> DataFrame:
    """The documents without later copies of repeated runs; a document that is all copies goes.

    Columns stay as they are but for the text, and for `n_chars` where there is one.
    """
    trimmed = _trimmed(docs, min_lines, id_column, text, min_words)
    left = trimmed.withColumn("__left", (F.size("__gone") == 0) | (F.size("__gone") < F.size("__worded")))
    new = F.when(F.size("__gone") == 0, F.col(f"`{text}`")).otherwise(_kept_text("__lines", "__gone"))
    left = settled(left.withColumn("__new", new), "__left").filter("__left")
    columns = [F.col("__new").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.size("__gone") == 0, F.col("n_chars")).otherwise(F.length("__new").cast(kind)).alias("n_chars")
        columns[docs.columns.index("n_chars")] = length
    return left.select(*columns)


def line_report(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", min_words: int | None = None
) -> DataFrame:
    """One row per document: lines with a word, deleted lines, copied windows, and a digest of what is left."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    trimmed = _trimmed(narrow, min_lines, "doc_id", "text", min_words)
    windows = F.coalesce(F.size("__windows"), F.lit(0))
    return trimmed.select(
        "doc_id",
        F.size("__worded").cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        F.greatest(windows, F.lit(0)).cast("long").alias("n_copied_windows"),
        F.sha2(_kept_text("__lines", "__gone"), 256).alias("kept_sha256"),
    )
