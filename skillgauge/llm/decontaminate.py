"""Benchmark decontamination by winnowing (operator 5).

A k-gram is a fingerprint if its hash is the smallest in some window of n - k + 1 consecutive k-grams,
so every span of n words holds a fingerprint, and equal spans hold the same one. Documents and
benchmark items meet on fingerprints; each meeting is then extended to the up to n - k + 1 spans of n
words around the fingerprint, which are compared by the hash of the whole span. No shared span of n
words is lost, and nothing shorter counts. Items shorter than n words are one span of their own
length each, and their fingerprint is the whole span.

Spans are compared by 64-bit hashes of all their words and of the fingerprint inside them.

Defined results: null and wordless texts have no spans; rows with the same id and text give the same
result once per row; equal items all count; an empty benchmark hits nothing; other input columns,
whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.llm.columns import ascii_lower
from skillgauge.llm.storage import broadcast_if_small, stored

SPAN_WORDS = 10
GRAM_WORDS = 5
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def item_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{BREAKS}]+"), "")


def _grams(values: str, n: int, step: int = 1) -> Column:
    """Hashes of `values[i], values[i + step], …`, n of them, for every i that has them all."""
    column = F.col(values)
    firsts = F.slice(column, 1, F.greatest(F.size(column) - (n - 1) * step, F.lit(0)))
    if n == 1:
        return F.transform(firsts, lambda value: F.xxhash64(value))
    return F.transform(firsts, lambda value, i: F.xxhash64(value, *[F.get(column, i + k * step) for k in range(1, n)]))


def fingerprints(df: DataFrame, words: str, span: int, gram: int) -> DataFrame:
    """Adds `prints`: per fingerprint its position, its hash, and the hashes of the spans around it.

    `spans[t]` starts at `at - (span - gram) + t`; spans that would leave the text are null. Texts
    shorter than a span have no fingerprints.
    """
    width = span - gram + 1
    df = df.withColumn("__grams", _grams(words, gram))
    if width == 1:
        return df.withColumn(
            "prints", F.transform("__grams", lambda h, i: F.struct(i.alias("at"), h.alias("print"), F.array(h).alias("spans")))
        ).drop("__grams")
    if span > 2 * gram:
        raise ValueError("two grams have to cover a span")
    grams = F.col("__grams")
    window = F.slice(grams, 1, F.greatest(F.size(grams) - (width - 1), F.lit(0)))
    df = df.withColumn("__minima", F.transform(window, lambda h, i: F.least(h, *[F.get(grams, i + k) for k in range(1, width)])))
    df = df.withColumn("__spans", _grams("__grams", 2, width - 1))
    minima, spans = F.col("__minima"), F.col("__spans")

    def chosen(h: Column, i: Column) -> Column:
        # The smallest of some window: no window around i has a smaller minimum than all others.
        around = F.greatest(*[F.get(minima, i - k) for k in range(width)])
        return F.when(
            h == around,
            F.struct(i.alias("at"), h.alias("print"), F.array(*[F.get(spans, i - (width - 1) + t) for t in range(width)]).alias("spans")),
        )

    marked = F.filter(F.transform(grams, chosen), lambda entry: entry.isNotNull())
    return df.withColumn("prints", marked).drop("__grams", "__minima", "__spans")


def benchmark_spans(items: DataFrame, id_column: str, text: str, span: int) -> tuple[DataFrame, list[int]]:
    """item_id, item words and the span width of the item; and all widths, of which there are at most `span`."""
    worded = items.select(F.col(id_column).alias("item_id"), item_words(F.col(text)).alias("item")).filter(F.size("item") > 0)
    table = stored(worded.withColumn("width", F.least(F.size("item"), F.lit(span))), "benchmark")
    widths = sorted(row["width"] for row in table.select("width").distinct().collect())
    return table, widths


def find_spans(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN_WORDS,
    gram: int = GRAM_WORDS,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The documents with their shared spans, and the items of each span.

    First table: doc_id, digest (of the text), copies (equal rows), n_words, hits (width, start, span
    hash; each once). Second table: width, span, item_id.
    """
    # Lists are taken apart by the outer form throughout: the inner one filters on the whole list first,
    # and the optimiser writes all that the list is made of into that filter.
    table, widths = benchmark_spans(items, item_column, item_text, span)
    prints, owners = [], []
    for width in widths:
        k = min(gram, width) if width == span else width
        entries = fingerprints(table.filter(F.col("width") == width), "item", width, k).select("item_id", F.explode_outer("prints").alias("p"))
        flat = entries.select(F.lit(width).alias("width"), F.col("p.print").alias("print"), "item_id", F.explode_outer("p.spans").alias("span"))
        flat = flat.filter(F.col("span").isNotNull())
        owners.append(flat.select("width", "span", "item_id").distinct())
        prints.append(flat.groupBy("width", "print").agg(F.collect_set("span").alias("known")))
    schema = "width int, print bigint, known array<bigint>"
    known = _all(prints, docs, schema)
    owner = _all(owners, docs, f"width int, span bigint, item_id {items.schema[item_column].dataType.simpleString()}")
    known, owner = stored(known, "prints"), stored(owner, "owners")

    base = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), item_words(F.col(text)).alias("__words")
    )
    # Every document sends one row of width 0, so that none gets lost; its digest spreads these rows.
    nothing = F.struct(
        F.lit(0).alias("width"), F.lit(0).alias("at"), F.coalesce("digest", F.lit(0)).alias("print"), F.lit(None).cast("array<bigint>").alias("spans")
    )
    df, parts = base, [F.array(nothing)]
    for width in widths:
        k = min(gram, width) if width == span else width
        df = fingerprints(df, "__words", width, k).withColumnRenamed("prints", f"__prints{width}")
        parts.append(_tagged(f"__prints{width}", width))
    sent = df.select("doc_id", "digest", F.size("__words").cast("long").alias("n_words"), F.explode_outer(F.concat(*parts)).alias("p"))
    sent = sent.select("doc_id", "digest", "n_words", "p.*")
    small = broadcast_if_small(known, 24 + 8 * F.size("known"))
    met = sent.join(small, ["width", "print"], "left").filter((F.col("width") == 0) | F.col("known").isNotNull())
    edge = F.when(F.col("width") == span, F.lit(span - min(gram, span))).otherwise(F.lit(0))
    hits = F.filter(
        F.transform("spans", lambda s, t: F.struct("width", (F.col("at") - edge + t).alias("start"), s.alias("span"))),
        lambda hit: hit["span"].isNotNull() & F.array_contains("known", hit["span"]),
    )
    met = met.select("doc_id", "digest", "n_words", (F.col("width") == 0).alias("own"), F.when(F.col("width") != 0, hits).alias("hits"))
    found = (
        met.filter(F.col("own") | (F.size("hits") > 0))
        .groupBy("doc_id", "digest")
        .agg(
            F.count_if("own").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        )
    )
    return found, owner


def _tagged(prints: str, width: int) -> Column:
    return F.transform(
        prints,
        lambda p: F.struct(F.lit(width).alias("width"), p["at"].alias("at"), p["print"].alias("print"), p["spans"].alias("spans")),
    )


def _all(frames: Sequence[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    found = like.sparkSession.createDataFrame([], schema)
    for frame in frames:
        found = found.unionByName(frame)
    return found


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: its words, the words inside shared spans, and the items that share them."""
    found, owner = find_spans(docs, items, **options)
    found = stored(found, "contaminated")
    # Positions covered by spans of any width: spans come by start, each adds what lies beyond the last end.
    by_start = F.array_sort(F.transform("hits", lambda hit: F.struct(hit["start"].alias("start"), hit["width"].alias("width"))))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        by_start,
        nothing,
        lambda acc, hit: F.struct(
            (acc["n"] + F.greatest(F.lit(0), hit["start"] + hit["width"] - F.greatest(acc["end"], hit["start"]))).cast("long").alias("n"),
            F.greatest(acc["end"], hit["start"] + hit["width"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    spans = found.select("doc_id", "digest", F.explode(F.array_distinct(F.transform("hits", lambda hit: F.struct(hit["width"], hit["span"])))).alias("hit"))
    named = spans.select("doc_id", "digest", "hit.width", "hit.span").join(broadcast_if_small(owner, 32), ["width", "span"])
    shared = named.groupBy(F.struct("doc_id", "digest").alias("key")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    joined = found.withColumn("key", F.struct("doc_id", "digest")).join(shared, "key", "left")
    rows = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    items_list = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        "digest",
        items_list.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that share no span with the benchmark, with their own columns."""
    found, _ = find_spans(docs, items, id_column=id_column, text=text, **options)
    bad = found.filter(F.size("hits") > 0).select(F.struct("doc_id", "digest").alias("__bad"))
    key = F.struct(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("digest"))
    bad = stored(bad, "contaminated")
    bad = broadcast_if_small(bad, 32)
    return docs.join(bad, key == bad["__bad"], "left_anti")
