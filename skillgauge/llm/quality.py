"""Quality rules as a short-circuit cascade (operator 6).

Each rule is a native expression over counts of the text. On a bounded sample every rule is timed and
its share of rejections counted; the rules then run in the order of rejections per second, and a
document that one rule rejects is not looked at by the later ones. The order decides only what a
document costs: the verdict is the conjunction of all rules, whatever the order.

Defined results: a null or blank text has no words and fails `too_few_words`; ties between rules keep
the order given; repeated rows are judged one by one; an empty table gives an empty table; a column named like
a count is taken for that count, one named `rejected_by` is replaced, all others are kept, whatever
their names; texts of any length are read in whole, one at a time.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.llm.columns import SPACE, count_characters, covered, settled, words

#: Bounds of the sample on which rules are timed; it settles the order of the rules and nothing else.
SAMPLE_ROWS = 500
SAMPLE_SHARE = 0.2
SAMPLE_CHARACTERS = 65_536

SYMBOLS = r"#*$%&|<>"
WINDOW = 5

# Names of the intermediate columns.
_WORDS, _LINES, _HASHES, _TWICE, _PAIRS, _STARTS = (f"__quality_{n}" for n in ("words", "lines", "hashes", "twice", "pairs", "starts"))

_WORD_COUNTS = {"n_words", "word_chars", "n_repeat_words"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_exclamations", "n_repeat_words")

#: The counts that a report shows.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a document when `rejects`, over the columns named in `needs`, is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Column | str

    def condition(self) -> Column:
        return F.coalesce(F.expr(self.rejects) if isinstance(self.rejects, str) else self.rejects, F.lit(False))


RULES = (
    Rule("too_few_words", ("n_words",), "n_words < 10"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "10 * n_dup_lines > 5 * n_lines"),
    Rule("exclamations", ("n_words", "n_exclamations"), "10 * n_exclamations > 3 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars > 20 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_words")


def with_counts(docs: DataFrame, needs: Sequence[str] = COUNTS, text: str = "text", unless: Column | None = None, keep_words: bool = False) -> DataFrame:
    """`docs` with the count columns named in `needs`, each over the whole text.

    Where `unless` is true the counts are null and are not worked out. With `keep_words` the list of
    words stays for the next call, which then does not split the text again. A repeated window is one whose
    five words occur twice or more in the text; windows are compared by a 64-bit hash.
    """
    todo = F.lit(True) if unless is None else ~unless
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    only = lambda column: F.when(todo, column)
    out: dict[str, Column] = {}
    df = docs
    if _WORD_COUNTS & set(needs):
        if _WORDS not in df.columns:
            df = df.withColumn(_WORDS, only(words(F.col(f"`{text}`"))))
        if "n_words" in needs:
            out["n_words"] = F.size(_WORDS).cast("long")
        if "word_chars" in needs:
            out["word_chars"] = F.length(F.array_join(_WORDS, "")).cast("long")
    if "n_symbols" in needs:
        out["n_symbols"] = count_characters(body, SYMBOLS).cast("long")
    if "n_exclamations" in needs:
        out["n_exclamations"] = count_characters(body, "!").cast("long")
    if {"n_lines", "n_dup_lines"} & set(needs):
        df = df.withColumn(_LINES, only(F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))))
        out["n_lines"] = F.size(_LINES).cast("long")
        out["n_dup_lines"] = (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("long")
    if "n_repeat_words" in needs:
        df = _repeated_windows(df)
        out["n_repeat_words"] = F.when(F.size(_TWICE) == 0, F.lit(0).cast("long")).otherwise(covered(F.col(_STARTS), WINDOW))
    taken = df.withColumns({name: only(out[name]) for name in needs})
    return taken.drop(*([] if keep_words else [_WORDS]), _LINES, _HASHES, _TWICE, _PAIRS, _STARTS)


def _repeated_windows(df: DataFrame) -> DataFrame:
    """Sorted starts of the windows that occur twice; texts without one skip the sort of positions."""
    word = F.col(_WORDS)
    whole = F.slice(word, 1, F.greatest(F.size(word) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(whole, lambda first, i: F.xxhash64(first, *[F.get(word, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn(_HASHES, hashes)
    df = df.withColumn(_TWICE, F.sort_array(_HASHES))
    df = df.withColumn(_TWICE, F.filter(_TWICE, lambda h, i: h == F.get(F.col(_TWICE), i + 1)))
    pairs = F.sort_array(F.transform(_HASHES, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(_PAIRS, F.when(F.size(_TWICE) > 0, pairs))
    beside = lambda i, step: F.get(F.col(_PAIRS), i + step)["h"]
    kept = F.filter(_PAIRS, lambda pair, i: (pair["h"] == beside(i, 1)) | (pair["h"] == beside(i, -1)))
    return df.withColumn(_STARTS, F.sort_array(F.transform(kept, lambda pair: pair["i"])))


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float
    rejected: int
    rows: int

    @property
    def rate(self) -> float:
        """Rejections per second of work."""
        return self.rejected / max(self.seconds, 1e-6)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, given: Sequence[str] = ()) -> list[RuleCost]:
    """Time every rule alone on a bounded sample and count what it rejects.

    The sample is taken from the first partitions that fill it, so its cost does not grow with the table.
    Counts named in `given` cost a rule nothing.
    """
    body = F.col(f"`{text}`")
    usual = docs.select(body.alias("text")).filter(body.isNull() | (F.length(body) <= SAMPLE_CHARACTERS))
    taken = usual.sample(SAMPLE_SHARE, seed=17).take(rows)
    sample = with_counts(docs.sparkSession.createDataFrame(taken, usual.schema), given).persist()
    try:
        n = sample.count()
        costs = []
        for rule in rules:
            missing = [name for name in rule.needs if name not in given]
            judged = with_counts(sample, missing).agg(F.count_if(rule.condition()).alias("n"))
            seconds = []
            for _ in range(2):  # the first run compiles
                started = time.perf_counter()
                rejected = judged.first()["n"]
                seconds.append(time.perf_counter() - started)
            costs.append(RuleCost(rule.name, min(seconds), rejected, n))
        return costs
    finally:
        sample.unpersist()


def cascade_order(costs: Sequence[RuleCost], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by rejections per second, most first; ties keep the given order."""
    rate = {cost.name: cost.rate for cost in costs}
    return sorted(rules, key=lambda rule: -rate[rule.name])


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", order: Sequence[Rule] | None = None) -> DataFrame:
    """`docs` with `rejected_by`, the first rule of the cascade that rejects the document, or null.

    Counts that the documents already carry are used as they are; a missing count is worked out only
    where no earlier rule has rejected the document. What a rule has worked out, its verdict and the
    words, is held behind a barrier: the optimiser would else write it into every later rule and into filters on the result.
    """
    given = [name for name in COUNTS if name in docs.columns]
    order = list(order) if order is not None else cascade_order(estimate(docs, rules, text, given=given), rules)
    verdict = "__quality_verdict"
    df = docs.withColumn(verdict, F.lit(None).cast("string"))
    made: list[str] = []
    for at, rule in enumerate(order):
        missing = [name for name in rule.needs if name not in df.columns]
        later = {name for r in order[at + 1 :] for name in r.needs} - set(df.columns) - set(missing)
        if missing:
            df = with_counts(df, missing, text, unless=F.col(verdict).isNotNull(), keep_words=bool(later & _WORD_COUNTS))
            made += missing
        df = df.withColumn(verdict, F.coalesce(F.col(verdict), F.when(rule.condition(), F.lit(rule.name))))
        df = settled(df, verdict, *missing, *[c for c in (_WORDS,) if c in df.columns])
    return df.drop("rejected_by", _WORDS, *made).withColumnRenamed(verdict, "rejected_by")


def keep_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Own columns named like a count would stand in for it, so the cascade sees the text alone.
    """
    own = docs.columns
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    kept = quality_cascade(seen, rules, "__text").filter(F.col("rejected_by").isNull())
    return kept.select("__row.*")


def quality_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, the base verdict and the verdict of the cascade.

    The five reported counts are wanted for every document; the others are left to the cascade, which works
    them out for documents that no rule before has rejected.
    """
    base = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    counted = settled(with_counts(base, REPORTED, "__text"), *REPORTED)
    order = cascade_order(estimate(base, RULES, "__text", given=REPORTED))
    judged = quality_cascade(counted, RULES, "__text", order)
    failed = F.lit(False)
    for rule in RULES:
        if rule.name in BASE_RULES:
            failed = failed | rule.condition()
    return judged.select("doc_id", *REPORTED, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
