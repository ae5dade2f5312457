"""Phrase collocation mining over a weighted de Bruijn graph (operator 13).

A text falls into pieces at punctuation and line ends, a piece into words. Every word of a piece starts one
edge: the longest gram, of up to `longest` words, that begins there and stays in the piece. Edges are
aggregated, within tasks and then by their first two words. A shorter phrase is a node, and its count is its flow: the
edges that leave it, plus the shorter grams that begin at it and stop at the end of a piece.

A sieve keeps the graph small without a loss. A phrase cannot be frequent if one of its words, pairs or triples
is not, so before the edges are built, words, then pairs of kept words, then triples of kept pairs are
counted, and a piece is broken where one of them is rarer than `least`. What has passed is a bitmap
over hashes. Its size is bounded, whatever the corpus, and a bit set for two grams only keeps more: the counts of
frequent phrases stay exact, and a bitmap that fills up sieves less.

Unary paths are compacted: a node whose whole flow passes through one edge, in or out, says nothing that the longer
phrase does not say, and goes. As counts never grow with length, looking one word to either side finds every longer
phrase with the same count.

Words are compared by 64-bit hashes, which depend on the language. Scores are exact: products are decimals
of up to 37 digits, which holds for counts below 10^15.

Defined results: null texts have no words; null languages are `und`; repeated rows count as often as they stand there;
an empty table gives an empty table; texts of any length are read in whole and cut into nothing; only the language
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skillgauge.llm.storage import broadcast_if_small, stored
from skillgauge.llm.tokens import Words, salted, sequences, slices

#: Words of the longest phrase.
LONGEST = 5
#: Occurrences that make a phrase a candidate.
LEAST = 100
#: Phrases reported per language.
TOP = 2000
#: A sieve has at most two to this power bits: 16 MB.
_MOST_BITS = 27
#: Text worked on at a time, and rows that a task adds up before it passes them on.
_SLICE = 6 << 20
_HELD = 1 << 20
#: Words of the corpus for each shard of the graph.
_SHARD_WORDS = 20_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True
_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Pieces:
    """The words of some texts: `hashes` that depend on the language, and `piece`, which differs between pieces."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.words = Words(part.column("text"), lower=True, separator=_SEPARATOR)
        owner = self.words.owners()
        encoded = part.column("lang").dictionary_encode()
        self.langs = encoded.dictionary
        self.lang = encoded.indices.to_numpy()[owner]
        of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            self.hashes = salted(self.words.hashes + of_lang[self.lang], 13)
        self.piece = np.cumsum(_BREAK[self.words.data], dtype=np.int32)[self.words.starts] + owner

    def text_of(self, at: np.ndarray) -> pa.Array:
        raw = self.words.data.tobytes().translate(_ASCII_LOWER)
        return pa.array([raw[a:b].decode() for a, b in zip(self.words.starts[at].tolist(), self.words.ends[at].tolist())], pa.string())


def _set_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    index = hashes >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[index >> np.uint64(6)] >> (index & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grams(pieces: _Pieces, k: int) -> np.ndarray:
    return pieces.hashes if k == 1 else sequences(pieces.hashes, k)


def _runs(pieces: _Pieces, sieves: list[np.ndarray]) -> np.ndarray:
    """How many of the sieves' grams, from one word on, begin at each word: k if the k words there passed."""
    n = len(pieces.hashes)
    width = np.zeros(n, np.int64)
    passed = np.ones(n, bool)
    for k, bits in enumerate(sieves, 1):
        passed = _whole(passed, pieces.piece, k)
        passed[: max(n - k + 1, 0)] &= _set_bits(bits, _grams(pieces, k))
        width[passed] = k
    return width


def _whole(passed: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
    """Where k words of one piece begin whose first and last k - 1 words passed."""
    if k == 1:
        return passed.copy()
    out = np.zeros(len(passed), bool)
    out[:-1] = passed[:-1] & passed[1:]
    out[: len(out) - k + 1] &= piece[: len(out) - k + 1] == piece[k - 1 :]
    out[max(len(out) - k + 1, 0) :] = False
    return out


_Counts = tuple[np.ndarray, np.ndarray, list[pa.Array]]


def _scanned(texts: DataFrame, work: Callable[[_Pieces], _Counts], shown: Callable[[_Counts], list[pa.Array]], schema: str) -> DataFrame:
    """Columns that `shown` makes of the results of `work`: sorted distinct keys of a stretch of text, their counts and more
    columns. A task adds up the stretches it sees, as long as that makes them fewer, before anything is shuffled."""
    names = [field.split()[0] for field in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Counts] = []
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                held.append(work(_Pieces(part)))
                if sum(len(keys) for keys, _, _ in held) > _HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield pa.RecordBatch.from_arrays(shown(held.pop()), names=names)
        if held:
            yield pa.RecordBatch.from_arrays(shown(_added(held)), names=names)

    return texts.mapInArrow(scan, schema)


def _as_rows(counts: _Counts) -> list[pa.Array]:
    keys, n, more = counts
    return [pa.array(keys.view(np.int64)), *more, pa.array(n)]


def _added(parts: list[_Counts]) -> _Counts:
    """Several such results as one."""
    if len(parts) == 1:
        return parts[0]
    keys, at, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate([p[1] for p in parts]))
    return keys, n, [pa.concat_arrays(columns).take(pa.array(at)) for columns in zip(*(p[2] for p in parts))]


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each stands first, and how often it stands there."""
    return np.unique(hashes, return_index=True, return_counts=True)


def _word_counts(texts: DataFrame) -> DataFrame:
    """hash, lang, word, n of every word."""

    def work(pieces: _Pieces) -> _Counts:
        keys, at, n = _counted(pieces.hashes)
        return keys, n, [pieces.langs.take(pa.array(pieces.lang[at], pa.int32())), pieces.text_of(at)]

    found = _scanned(texts, work, _as_rows, "hash bigint, lang string, word string, n bigint")
    return found.groupBy("hash").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"))


def _gram_counts(texts: DataFrame, held, k: int) -> DataFrame:
    """hash, n of the grams of k words whose shorter grams passed the sieves so far."""

    def work(pieces: _Pieces) -> _Counts:
        passed = _runs(pieces, held.value) == k - 1
        hashes = sequences(pieces.hashes, k)
        keys, _, n = _counted(hashes[_whole(passed, pieces.piece, k)[: len(hashes)]])
        return keys, n, []

    return _scanned(texts, work, _as_rows, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _sieve(frequent: DataFrame) -> np.ndarray:
    """A bitmap over the leading bits of the hashes, about one bit in 64 set unless the bound is met."""
    n_bits = min(max(math.ceil(math.log2(64 * max(frequent.count(), 1))), 10), _MOST_BITS)
    index = F.shiftrightunsigned("hash", 64 - n_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), index.bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.groupBy(F.shiftright(index, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (n_bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _edges(texts: DataFrame, held, longest: int, n_shards: int) -> DataFrame:
    """shard, payload: the longest gram of two words or more that begins at each word, aggregated per task.

    All grams that begin with the same two words go to one shard, many of them in one packed row.
    """

    def packed(counts: _Counts) -> list[pa.Array]:
        _, n, [grams] = counts
        length = np.diff(grams.offsets.to_numpy())
        words = np.zeros((len(grams), longest), np.uint64)
        words[np.arange(longest) < length[:, None]] = grams.flatten().to_numpy().view(np.uint64)
        shard = sequences(words[:, :2].ravel(), 2)[::2] % np.uint64(n_shards)
        order = np.argsort(shard, kind="stable")
        found, first = np.unique(shard[order], return_index=True)
        rows = np.split(order, first[1:]) if len(found) else []
        return [pa.array(found.astype(np.int32)), pa.array([words[k].tobytes() + n[k].tobytes() for k in rows], pa.binary())]

    return _scanned(texts, lambda pieces: _longest_grams(pieces, held.value, longest), packed, "shard int, payload binary")


def _longest_grams(pieces: _Pieces, sieves: list[np.ndarray], longest: int) -> _Counts:
    width = _runs(pieces, sieves)
    most = len(sieves)
    # A gram is as long as the longest sieved grams overlap without a gap.
    full = width == most
    length = width.copy()
    for k in range(most + 1, longest + 1):
        full = _whole(full, pieces.piece, k)
        length[full] = k
    keys = pieces.hashes.copy()
    for k in range(2, longest + 1):
        at = np.flatnonzero(length == k)
        keys[at] = sequences(pieces.hashes, k)[at]
    begins = np.flatnonzero(length > 1)
    distinct, at, n = _counted(keys[begins])
    at = begins[at]
    ends = np.cumsum(length[at])
    spots = np.repeat(at - ends + length[at], length[at]) + np.arange(ends[-1] if len(ends) else 0)
    grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(pieces.hashes[spots].view(np.int64)))
    return distinct, n, [grams]


def _node_flows(edges: DataFrame, longest: int, least: int) -> DataFrame:
    """words, n of the frequent phrases of two words or more: every edge and every piece end flows through the phrases
    it begins with."""

    def flow(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(payload.as_py(), np.uint64).reshape(longest + 1, -1) for payload in table.column("payload")]
        words = np.concatenate([p[:longest].reshape(-1, longest) for p in parts])
        n = np.concatenate([p[longest] for p in parts]).view(np.int64)
        found, counts = [], []
        for k in range(2, longest + 1):
            there = np.flatnonzero(words[:, k - 1] != 0)
            hashes = sequences(words[there, :k].ravel(), k)[::k] if len(there) else np.empty(0, np.uint64)
            _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, back, n[there])
            often = np.flatnonzero(total >= least)
            found.extend(words[there[first[often]], :k].view(np.int64))
            counts.append(total[often])
        return pa.table({"words": pa.array(found, pa.list_(pa.int64())), "n": pa.array(np.concatenate(counts), pa.int64())})

    return edges.groupBy("shard").applyInArrow(flow, "words array<bigint>, n bigint")


def _compacted(flows: DataFrame) -> DataFrame:
    """Phrases of two words or more, without those whose whole flow passes through a longer one."""
    longer = flows.filter(F.size("words") > 2)
    parts = F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1))
    widest = longer.select("n", F.explode(parts).alias("words")).groupBy("words").agg(F.max("n").alias("most"))
    kept = flows.filter(F.size("words") > 1).join(widest, "words", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n")))
    return kept.drop("most")


def _named(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`phrases` with lang and the phrase as text."""
    spread = phrases.select("words", F.posexplode("words").alias("pos", "hash")).join(vocabulary.select("hash", "lang", "word"), "hash")
    texts = spread.groupBy("words").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("parts"))
    return phrases.join(texts.select("words", "lang", F.array_join("parts.word", " ").alias("phrase")), "words")


def lift(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000·a·n / (left·right)), exactly."""
    wide = lambda column: column.cast("decimal(18,0)")
    return F.call_function("div", wide(1000 * a) * wide(n), wide(left) * wide(right))


def _scored(candidates: DataFrame, flows: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: l, r, score."""
    first, rest = (flows.select(F.col("words").alias(f"{side}_words"), F.col("n").alias(side)) for side in ("l", "r"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("l_words", F.slice("words", F.lit(1), F.col("k"))).withColumn("r_words", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    both = cuts.join(first, "l_words").join(rest, "r_words").withColumn("score", lift(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two to `longest` words that is frequent and on no unary path."""
    session = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words = stored(_word_counts(texts), "words")
    vocabulary = words.filter(F.col("n") >= least)
    sieves = [_sieve(vocabulary)]
    for k in range(2, min(longest, 3) + 1):
        held = session.sparkContext.broadcast(sieves)
        frequent = stored(_gram_counts(texts, held, k).filter(F.col("n") >= least).select("hash"), "grams")
        sieves = [*sieves, _sieve(frequent)]
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    n_shards = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-(totals.agg(F.sum("n")).first()[0] or 0) // _SHARD_WORDS))
    edges = _edges(texts, session.sparkContext.broadcast(sieves), longest, n_shards)
    singles = vocabulary.select(F.array("hash").alias("words"), "n")
    flows = stored(_node_flows(edges, longest, least).unionByName(singles), "flows")
    named = _named(_compacted(flows).withColumnRenamed("n", "a"), vocabulary)
    candidates = stored(named.join(broadcast_if_small(totals, 64), "lang"), "candidates")
    return _scored(candidates, flows)


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first `top` phrases of each language by score, count and text: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = mine_phrases(docs, **options).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
