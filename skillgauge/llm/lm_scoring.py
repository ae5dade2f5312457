"""N-gram scoring with deleted interpolation (operator 8).

A bigram model is counted over all training documents. The probability of a token mixes the bigram
and the unigram maximum-likelihood estimates and a uniform floor; the weights depend on how often the
context was seen, in buckets of powers of two, and are learned by expectation-maximisation on deleted
counts: every training token in turn is held out of the counts it is predicted from.

Counts are asked for by blocks of documents and answered by shards of hashes, see `blocks`. The
occurrences then carry their counts in a packed column, so that learning and scoring are two scans of
that table. What EM needs of the tokens is a histogram over context buckets and the two likelihood
ratios in steps of a quarter octave, over all training tokens; its size is bounded by its bins, and it
is all that reaches the driver beside the totals.

Tokens are equal if their 64-bit hashes are. The end of a text is a token; its begin is a context.

Defined results: a null text is empty and consists of its end; ids are integers, a null id hashes as
the empty string; equal rows count and are scored once each; with nothing to learn from, every token
has the probability of the uniform floor; an empty table gives an empty table; only the id and the
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from skillgauge.llm import blocks
from skillgauge.llm.storage import stored
from skillgauge.llm.tokens import Words, salted, sequences, slices

BUCKETS = 40
BINS_PER_OCTAVE = 4
EM_STEPS = 60
_TOTALS = -1
# Hashes of the end token and of the context before the first token; words are mixed hashes, too.
_END, _BEGIN = salted(np.array([1, 2], np.uint64), 99)
# The lowest bit tells single tokens from pairs.
_PAIR = np.uint64(1)

_ASK = "shard int, block int, payload binary"
_ANSWER = "block int, shard int, payload binary"
_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, payload binary"


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _tokens(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, of their pairs with the token before, where each text begins, and tokens a text."""
    words = Words(part.column("text").combine_chunks(), lower=True)
    counts = words.counts() + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = words.hashes, _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _BEGIN
    pairs = sequences(np.stack([before, tokens], 1).ravel(), 2)[::2] if len(tokens) else tokens
    return tokens & ~_PAIR, pairs | _PAIR, first, counts


def _rows(columns: Sequence[list], names: Sequence[str]) -> pa.Table:
    kinds = {"payload": pa.binary()}
    return pa.table({name: pa.array(column, kinds.get(name, pa.int32())) for name, column in zip(names, columns)})


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all that a block needs counts of, with its own training counts."""
    keys, amounts = [np.array([_BEGIN & ~_PAIR])], [np.zeros(1, np.int64)]
    training = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    keys.append(keys[0])
    amounts.append(np.array([training.sum()]))
    at = 0
    for part in slices(table, "text"):
        tokens, pairs, _, counts = _tokens(part)
        learn = np.repeat(training[at : at + part.num_rows], counts)
        at += part.num_rows
        for hashes in (tokens, pairs):
            order = np.argsort(hashes)
            sorted_hashes = hashes[order]
            first = np.flatnonzero(np.diff(sorted_hashes, prepend=~sorted_hashes[:1]) != 0)
            if len(first):
                keys.append(sorted_hashes[first])
                amounts.append(np.add.reduceat(learn[order].astype(np.int64), first))
    every, amount = np.concatenate(keys), np.concatenate(amounts)
    order = np.argsort(every)
    every, amount = every[order], amount[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0)
    return every[first], np.add.reduceat(amount, first)


def ask_step(n_shards: int):
    bounds = blocks.shard_bounds(n_shards)

    def step(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        hashes, amounts = _distinct(table)
        shard, owner, payload = [], [], []
        for number, a, b in blocks.by_shard(hashes, bounds):
            packed = blocks.pack_sorted(hashes[a:b])
            shard.append(number)
            owner.append(block)
            payload.append(np.uint32(len(packed)).tobytes() + packed + blocks.pack(amounts[a:b]))
        return _rows([shard, owner, payload], ["shard", "block", "payload"])

    return step


def count_step(key: tuple, table: pa.Table) -> pa.Table:
    """Adds up the counts of a shard, answers each block in its order, and reports the totals of the shard."""
    shard = key[0].as_py()
    owners, keys, amounts = table.column("block").to_pylist(), [], []
    for payload in table.column("payload"):
        payload = payload.as_py()
        size = int(np.frombuffer(payload, np.uint32, 1)[0])
        keys.append(blocks.unpack_sorted(payload[4 : 4 + size]))
        amounts.append(blocks.unpack(payload[4 + size :]).astype(np.int64))
    every, amount = np.concatenate(keys), np.concatenate(amounts)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0)
    distinct, totals = every[first], np.add.reduceat(amount[order], first)
    replies = [blocks.pack(totals[np.searchsorted(distinct, own)]) for own in keys]
    single = ((distinct & _PAIR) == 0) & (distinct != (_BEGIN & ~_PAIR)) & (totals > 0)
    sums = np.array([totals[single].sum(), single.sum()], np.int64).tobytes()
    return _rows([[*owners, _TOTALS], [shard] * (len(owners) + 1), [*replies, sums]], ["block", "shard", "payload"])


def attach_step(n_shards: int):
    """Per document: its sums, and the counts of all its tokens and pairs, packed."""

    def step(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [field.split()[0] for field in _SCORED.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        if not table.num_rows:
            sums = sum((np.frombuffer(p.as_py(), np.int64) for p in replies.column("payload")), np.zeros(2, np.int64))
            columns = [[None], [None], [int(sums[0])], [int(sums[1])], [None], [None]]
            return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, columns, kinds)})
        answered = {number: payload.as_py() for number, payload in zip(replies.column("shard").to_pylist(), replies.column("payload"))}
        hashes, _ = _distinct(table)
        totals = np.concatenate([blocks.unpack(answered[number]) for number, _, _ in blocks.by_shard(hashes, blocks.shard_bounds(n_shards))])
        begin = totals[np.searchsorted(hashes, _BEGIN & ~_PAIR)]
        n_tokens, n_known, logs, payloads = [], [], [], []
        for part in slices(table, "text"):
            tokens, pairs, first, counts = _tokens(part)
            single = totals[np.searchsorted(hashes, tokens)]
            pair = totals[np.searchsorted(hashes, pairs)]
            n_tokens.append(counts)
            n_known.append(np.add.reduceat((single > 0).astype(np.int64), first[:-1]))
            logs.append(np.add.reduceat(np.log10(single + 1.0), first[:-1]))
            for a, b in zip(first[:-1], first[1:]):
                context = np.concatenate([[begin], single[a : b - 1]])
                payloads.append(_pack_counts(context, single[b - 1], pair[a:b]))
        columns = [table.column("doc_id"), table.column("held_out"), np.concatenate(n_tokens), np.concatenate(n_known), np.concatenate(logs), payloads]
        return pa.table({name: column if isinstance(column, pa.ChunkedArray) else pa.array(column, kind) for name, column, kind in zip(names, columns, kinds)})

    return step


def _pack_counts(context: np.ndarray, last: np.integer, pair: np.ndarray) -> bytes:
    """Context counts of all tokens, the count of the last token, and pair counts; a token is the next one's context."""
    packed = blocks.pack(np.append(context, last))
    return np.uint32(len(packed)).tobytes() + packed + blocks.pack(pair)


def _unpack_counts(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(np.frombuffer(payload, np.uint32, 1)[0])
    chain = blocks.unpack(payload[4 : 4 + size]).astype(np.float64)
    return chain[:-1], chain[1:], blocks.unpack(payload[4 + size :]).astype(np.float64)


def counted(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """One row per document with the counts of its tokens, and one row without an id holding the totals."""
    _, n_blocks = blocks.plan_blocks(docs, text, block_bytes)
    dealt = blocks.in_blocks(docs, n_blocks, id_column, text, held_out(F.col(f"`{id_column}`")).alias("held_out"))
    asked = dealt.groupBy("block").applyInArrow(ask_step(n_blocks), _ASK)
    answers = asked.groupBy("shard").applyInArrow(count_step, _ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(attach_step(n_blocks), _SCORED)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def _histogram(n_training: int, n_types: int):
    """Per batch: how many training tokens have which context bucket and which likelihood ratios, deleted."""
    floor = 1.0 / (n_types + 1)

    def binned(ratio: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            steps = np.floor(np.log2(ratio) * BINS_PER_OCTAVE)
        return np.where(ratio > 0, np.clip(steps, -500, 500) + 501, 0).astype(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for payload in batch.column(0):
                context, single, pair = _unpack_counts(payload.as_py())
                left = context - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    high = np.where(left > 0, (pair - 1) / left, 0.0) / floor
                low = (single - 1) / max(n_training - 1, 1) / floor
                codes.append((_bucket(np.maximum(left, 0)) * 1024 + binned(high)) * 1024 + binned(low))
            values, n = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return scan


@dataclass(frozen=True)
class Interpolation:
    """Mixture weights by context bucket: bigram, unigram, floor; each row adds up to one."""

    weights: np.ndarray
    n_training: int
    n_types: int

    def log10(self, context: np.ndarray, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        weight = self.weights[_bucket(context)]
        high = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        return np.log10(weight[:, 0] * high + weight[:, 1] * single / max(self.n_training, 1) + weight[:, 2] / (self.n_types + 1))


def learn_weights(histogram: Sequence[Row], n_training: int, n_types: int) -> Interpolation:
    """EM over the histogram; buckets without tokens fall back to the unigram."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    codes = np.array([row["code"] for row in histogram], np.int64)
    n = np.array([row["n"] for row in histogram], np.float64)
    bucket, high, low = codes >> 20, (codes >> 10) & 1023, codes & 1023
    value = lambda bins: np.where(bins > 0, 2.0 ** ((bins - 500.5) / BINS_PER_OCTAVE), 0.0)
    parts = np.stack([value(high), value(low), np.ones(len(codes))], 1)
    for _ in range(EM_STEPS):
        shares = weights[bucket] * parts
        shares *= (n / shares.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, shares[:, k], BUCKETS) for k in range(3)], 1).astype(float)
        # One token's worth of the start values keeps every weight above zero.
        sums += [0.5, 0.4, 0.1]
        weights = sums / sums.sum(1, keepdims=True)
    unseen = np.bincount(bucket, n, BUCKETS) == 0
    weights[unseen] = [0.5, 0.4, 0.1]
    # An unseen context says nothing about pairs; unigram and floor keep their learned shares.
    weights[0] = [0.0, 0.9, 0.1] if unseen[0] else [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    if not n_training:
        weights[0] = [0.0, 0.0, 1.0]
    return Interpolation(weights, n_training, n_types)


def fit(table: DataFrame) -> Interpolation:
    """The model of a stored table of counted documents."""
    totals = table.filter("payload IS NULL").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_known").alias("types")).first()
    n_training, n_types = totals["tokens"] or 0, totals["types"] or 0
    training = table.filter("payload IS NOT NULL AND NOT held_out").select("payload")
    histogram = training.mapInArrow(_histogram(n_training, n_types), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return learn_weights(histogram.collect(), n_training, n_types)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> tuple[DataFrame, Interpolation]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and the model."""
    table = stored(counted(docs, id_column, text, block_bytes), "counted")
    model = fit(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [float(model.log10(*_unpack_counts(payload.as_py())).sum()) for payload in batch.column("payload")]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    rows = table.filter("payload IS NOT NULL")
    scored = rows.mapInArrow(scan, _SCORED.replace("payload binary", "score double"))
    floor = F.log10(F.lit(float(model.n_training + model.n_types + 1)))
    return (
        scored.select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(model.n_training).cast("long").alias("train_tokens"),
            (F.col("log_counts") - F.col("n_tokens") * floor).alias("base_score"),
            "score",
        ),
        model,
    )
