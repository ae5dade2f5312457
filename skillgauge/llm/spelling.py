"""Spelling variant grouping by generation over a reduced alphabet (operator 12).

Two words are near if one inserted, deleted or replaced letter turns one into the other. To find near words
without comparing all, letters are hashed to a few symbols. A letter edit is at most one symbol edit, so
the reduced form of every near word lies in the one-edit neighbourhood of a word's own reduced form: the
form itself, one symbol less, one other, one more. There are about 2·s·length of them for s symbols instead of 2·54·length
over the letters. Neighbourhoods are generated once for each distinct reduced form, joined with the reduced
vocabulary, and only those hits are taken back to words and verified on the original strings.

The number of symbols grows with the sixth root of the vocabulary (`symbols_for`), so that the forms of short words stay about as
many as there are words and the number of words to a form does not grow with the corpus. Forms are compared by 64-bit
hashes; a collision only adds a candidate that is verified away.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that is
`ratio` times as frequent. Forms are followed to the last by doubling; every step multiplies the
count by `ratio`, so paths are short and have no cycles.

Defined results: null texts have no words; a null id writes as nothing before the colon of the deletion
hash; repeated rows count as often as they stand there; an empty table gives an empty table; texts of any
length are read in whole; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.llm.columns import ascii_lower
from skillgauge.llm.storage import stored
from skillgauge.llm.tokens import salted

#: Code points of the shortest word, and occurrences of the rarest.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times as frequent a form has to be.
RATIO = 5
#: One run in this many loses a code point.
DELETE_ONE_IN = 199
#: The bounds of the reduced alphabet.
_FEWEST, _MOST = 4, 24
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Neighbours generated at a time.
_CHUNK = 1 << 20


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """word, n of the frequent long words of a corpus whose runs lose a code point here and there.

    A run that is too short stays so, whether or not it loses a code point, and is not looked at.
    """
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def symbols_for(n_words: int) -> int:
    """How many symbols keep the forms of six letters about as many as the words."""
    return min(max(round(n_words ** (1 / LEAST_LENGTH)), _FEWEST), _MOST)


def _forms(words: pa.Array, symbols: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, symbols of their words) for each length of word."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    reduced = salted(points, 12) % np.uint64(symbols) + np.uint64(1)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    groups = []
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        groups.append((rows, reduced[first[rows][:, None] + np.arange(length)]))
    return groups


def _powers(n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * _BASE & _MASK)
    return np.array(out, np.uint64)


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    return salted(sums, length)


def _own(forms: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _key((forms * _powers(forms.shape[1])).sum(1, dtype=np.uint64), forms.shape[1])


def _neighbourhood(forms: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of the form itself and of all forms one symbol edit away, a row per form; some occur twice."""
    n, length = forms.shape
    powers = _powers(length + 1)
    values = np.arange(1, symbols + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        terms = forms * powers[:length]
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
        whole = before[:, -1:]
        # What follows a place, moved up or down by one place.
        up = (whole - before) * np.uint64(_BASE)
        down = (whole - before[:, 1:]) * np.uint64(pow(_BASE, -1, 1 << 64))
        others = ((forms[:, :, None] + values[: symbols - 1] - np.uint64(1)) % np.uint64(symbols)) + np.uint64(1)
        replaced = whole[:, :, None] + (others - forms[:, :, None]) * powers[None, :length, None]
        inserted = before[:, :, None] + values[None, None, :] * powers[None, :, None] + up[:, :, None]
        return np.concatenate(
            [_key(whole, length), _key(before[:, :-1] + down, length - 1), _key(replaced.reshape(n, -1), length), _key(inserted.reshape(n, -1), length + 1)], 1
        )


def _with_form(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, form_key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for rows, forms in _forms(batch.column("word"), symbols):
                keys[rows] = _own(forms)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys.view(np.int64))], names=["word", "n", "form_key"])

    return words.select("word", "n").mapInArrow(scan, "word string, n bigint, form_key bigint")


def _neighbours(forms: DataFrame, symbols: int) -> DataFrame:
    """form_key, near_key: the full one-edit neighbourhood of each distinct form, given by one of its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, every in _forms(batch.column("word"), symbols):
                each = 2 * symbols * (every.shape[1] + 1)
                step = max(_CHUNK // each, 1)
                for a in range(0, len(every), step):
                    near = np.sort(_neighbourhood(every[a : a + step], symbols), 1)
                    first = np.ones(near.shape, bool)
                    first[:, 1:] = near[:, 1:] != near[:, :-1]
                    own = np.repeat(_own(every[a : a + step]), first.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(near[first].view(np.int64))], names=["form_key", "near_key"])

    return forms.mapInArrow(scan, "form_key bigint, near_key bigint")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all pairs of near words, in both directions; `words` is word, n and materialised."""
    symbols = symbols_for(words.count())
    formed = stored(_with_form(words, symbols), "formed")
    forms = stored(formed.groupBy("form_key").agg(F.min("word").alias("word")), "forms")
    keys = forms.select(F.col("form_key").alias("near_key"))
    hits = _neighbours(forms.repartition("form_key").select("word"), symbols).join(keys, "near_key")
    one = hits.join(formed, "form_key").select("near_key", "word", "n")
    other = formed.select(F.col("form_key").alias("near_key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = one.join(other, "near_key").filter(_one_edit(F.col("word"), F.col("other")))
    return pairs.select("word", "n", "other", "other_n")


def _one_edit(a: Column, b: Column) -> Column:
    """Exactly one inserted, deleted or replaced code point."""
    close = F.abs(F.length(a) - F.length(b)) <= 1
    return close & (F.levenshtein(a, b, 1) == 1)


def _roots(formed: DataFrame) -> DataFrame:
    """word, root for words with a form, by doubling."""
    links = stored(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.join(onward, "root", "left")
        if longer.filter(F.col("next").isNotNull()).isEmpty():
            return links
        links = stored(longer.select("word", F.coalesce("next", "root").alias("root")), "links")


def spelling_forms(docs: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `word_counts`."""
    words = stored(word_counts(docs, **options), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    rises = -F.col("best.minus") >= ratio * F.col("n")
    formed = stored(
        joined.select("word", F.when(rises, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rises, -F.col("best.minus")).alias("form_n")),
        "forms",
    )
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
