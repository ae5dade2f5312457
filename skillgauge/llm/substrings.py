"""Substring dedup with a count-min prefilter (operator 3).

A window is n consecutive words of one document; a word goes if some window over it also starts in a
document with a smaller id. Pass one: every block of documents sketches its windows in the rows of a
count-min table, whose cells are merged shard by shard; the smaller of a window's two cells never
undercounts it. Pass two: only windows estimated to stand in two documents or more are grouped
exactly, by two hashes of all their words, 96 bits together, for the smallest id that holds them. The table has a
multiple of the number of windows as cells and is never gathered in one place: a block gets back which
of its own cells count two or more.

Cells count documents, up to two, since more makes no difference.

Defined results: ids are integers, a null id is smaller than all others; equal ids are the same
document and do not delete each other's words, whatever their texts; null and short texts have no
windows and lose nothing; kept words are joined by single spaces; an empty table gives an empty table;
only the id and the text are read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skillgauge.llm import blocks
from skillgauge.llm.tokens import Words, salted, sequences, slices, windows

WINDOW_WORDS = 13
#: Rows of the count-min table, and cells of a row for each window at least.
SKETCH_ROWS = 2
CELLS_PER_WINDOW = 4
#: A word and its gap have four bytes or more on average in most languages; fewer only fill the table more.
_BYTES_PER_WORD = 4
_NULL_ID = np.iinfo(np.int64).min

_ASK = "shard int, block int, payload binary"
_ANSWER = "block int, shard int, payload binary"


def _ids(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return pa.compute.fill_null(table.column("doc_id"), _NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _block_windows(table: pa.Table, n: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """Hash and document of every window of a block, and its second hash where that is wanted."""
    ids = _ids(table)
    hashes, owners, others, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    for part in slices(table, "text"):
        words = Words(part.column("text").combine_chunks())
        found, starts, owner = windows(words, n)
        hashes.append(found)
        owners.append(ids[at : at + part.num_rows][owner])
        if second:
            others.append(_second(words, n)[starts])
        at += part.num_rows
    return (np.concatenate(hashes), np.concatenate(owners), *([np.concatenate(others)] if second else []))


def _second(words: Words, n: int) -> np.ndarray:
    """32 bits of an independent hash of the words of each window."""
    return sequences(salted(words.hashes, 77), n) >> np.uint64(32)


def _per_hash(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes with the smallest and the largest id of each."""
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
    if not len(first):
        return hashes, owners, owners
    return hashes[first], np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)


def _rows(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)})


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each window in a row; cells of all rows are numbered through."""
    return (salted(hashes, row) % np.uint64(cells)) + np.uint64(row * cells)


def sketch_step(n: int, cells: int, per_shard: int):
    """A block's cells: which it fills, and which it fills from two documents or more."""

    def step(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        hashes, low, high = _per_hash(*_block_windows(table, n))
        shard, owner, payload = [], [], []
        for row in range(SKETCH_ROWS):
            filled = _cells(hashes, row, cells)
            order = np.argsort(filled)
            filled, several = filled[order], (low != high)[order]
            first = np.flatnonzero(np.diff(filled, prepend=~filled[:1]) != 0)
            if not len(first):
                continue
            # Two windows in one cell count as two documents: more than the truth, never less.
            again = np.maximum(np.logical_or.reduceat(several, first), np.diff(first, append=len(filled)) > 1)
            filled = filled[first]
            numbers = filled // np.uint64(per_shard)
            starts = np.flatnonzero(np.diff(numbers, prepend=~numbers[:1]) != 0)
            for a, b in zip(starts, [*starts[1:], len(filled)]):
                base = numbers[a] * np.uint64(per_shard)
                shard.append(int(numbers[a]))
                owner.append(block)
                payload.append(blocks.joined(blocks.pack_sorted(filled[a:b] - base), np.packbits(again[a:b]).tobytes()))
        return _rows(_ASK, [shard, owner, payload])

    return step


def merge_step(per_shard: int):
    """Adds up the cells of all blocks; tells each block which of its cells count two or more."""

    def step(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        counts = np.zeros(per_shard, np.uint8)
        owners, asked = table.column("block").to_pylist(), []
        for payload in table.column("payload"):
            packed, bits = blocks.parted(payload.as_py(), 2)
            cells = blocks.unpack_sorted(packed).astype(np.int64)
            again = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(cells)).astype(np.uint8)
            counts[cells] = np.minimum(counts[cells] + 1 + again, 2)
            asked.append(cells)
        replies = [blocks.pack_sorted(cells[counts[cells] > 1].astype(np.uint64)) for cells in asked]
        return _rows(_ANSWER, [owners, [shard] * len(owners), replies])

    return step


def ask_step(n: int, cells: int, per_shard: int, n_shards: int):
    """A block's windows that are estimated to repeat: hash and smallest id, shard by shard."""
    bounds = blocks.shard_bounds(n_shards)

    def step(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_ASK, [[], [], []])
        block = table.column("block")[0].as_py()
        numbers = replies.column("shard").to_numpy(zero_copy_only=False).astype(np.uint64)
        full = [
            blocks.unpack_sorted(payload.as_py()) + number * np.uint64(per_shard)
            for number, payload in zip(numbers, replies.column("payload"))
        ]
        full = np.sort(np.concatenate([np.empty(0, np.uint64), *full]))
        every, owners, others = _block_windows(table, n, second=True)
        hashes, low, _ = _per_hash(every, owners)
        likely = np.ones(len(hashes), bool)
        for row in range(SKETCH_ROWS):
            likely &= blocks.contained(_cells(hashes, row, cells), full)
        hashes, low = hashes[likely], low[likely]
        # Inside a block the first hash names a window; its second hash goes along to the shard.
        order = np.argsort(every)
        checks = others[order[np.searchsorted(every, hashes, sorter=order)]]
        shard, owner, payload = [], [], []
        for number, a, b in blocks.by_shard(hashes, bounds):
            shard.append(number)
            owner.append(block)
            # Ids as distances from their minimum, which is sent along.
            least = low[a:b].min()
            with np.errstate(over="ignore"):
                ids = (low[a:b] - least).view(np.uint64)
            payload.append(blocks.joined(blocks.pack_sorted(hashes[a:b]), blocks.pack(ids), least.tobytes(), blocks.pack(checks[a:b])))
        return _rows(_ASK, [shard, owner, payload])

    return step


def least_step(key: tuple, table: pa.Table) -> pa.Table:
    """The windows of each block that also stand in another block under a smaller id."""
    shard = key[0].as_py()
    owners, keys, ids, checks = table.column("block").to_pylist(), [], [], []
    for payload in table.column("payload"):
        packed, packed_ids, least, packed_checks = blocks.parted(payload.as_py(), 4)
        keys.append(blocks.unpack_sorted(packed))
        checks.append(blocks.unpack(packed_checks))
        with np.errstate(over="ignore"):
            ids.append((blocks.unpack(packed_ids).view(np.int64) + np.frombuffer(least, np.int64)[0]))
    every, check, every_id = np.concatenate(keys), np.concatenate(checks), np.concatenate(ids)
    order = np.lexsort((check, every))
    new = (np.diff(every[order], prepend=~every[order[:1]]) != 0) | (np.diff(check[order], prepend=~check[order[:1]]) != 0)
    first = np.flatnonzero(new)
    low = np.empty(len(every), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(every_id[order], first), np.diff(first, append=len(every)))
    smaller = low < every_id
    cuts = np.cumsum([0, *map(len, keys)])
    replies = [blocks.pack_sorted(own[smaller[a:b]]) for own, a, b in zip(keys, cuts[:-1], cuts[1:])]
    return _rows(_ANSWER, [owners, [shard] * len(owners), replies])


def cut_step(n: int):
    """Deletes the words of a block's documents that a repeated window covers."""

    def step(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids = table.column("doc_id")
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        elsewhere = np.sort(np.concatenate([np.empty(0, np.uint64), *[blocks.unpack_sorted(p.as_py()) for p in replies.column("payload")]]))
        distinct, low, _ = _per_hash(*_block_windows(table, n))
        numbers, at = _ids(table), 0
        n_words, n_removed, kept = [], [], []
        for part in slices(table, "text"):
            words = Words(part.column("text").combine_chunks())
            hashes, starts, owner = windows(words, n)
            own = numbers[at : at + part.num_rows][owner]
            at += part.num_rows
            gone = blocks.contained(hashes, elsewhere)
            if len(hashes):
                gone |= low[np.searchsorted(distinct, hashes)] < own
            marks = np.zeros(len(words.hashes) + 1, np.int64)
            marks[starts[gone]] += 1
            marks[starts[gone] + n] -= 1
            keep = np.cumsum(marks[:-1]) == 0
            counts = words.counts()
            lost = np.concatenate([[0], np.cumsum(~keep)])
            n_words.append(counts)
            n_removed.append(lost[words.first[1:]] - lost[words.first[:-1]])
            flags = keep.tolist()
            for k, value in enumerate(part.column("text")):
                # bytes.split() cuts at exactly the separators of a word.
                found = value.as_py().encode().split()
                a, b = words.first[k], words.first[k + 1]
                kept.append(b" ".join(compress(found, flags[a:b])).decode())
        return pa.table(
            {
                "doc_id": ids,
                "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )

    return step


def dedup_substrings(docs: DataFrame, window: int = WINDOW_WORDS, id_column: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text without words of windows that an earlier document holds."""
    size, n_blocks = blocks.plan_blocks(docs, text, block_bytes)
    cells = max(1024, CELLS_PER_WINDOW * size // _BYTES_PER_WORD)
    per_shard = -(-SKETCH_ROWS * cells // n_blocks)
    dealt = blocks.in_blocks(docs, n_blocks, id_column, text)
    sketches = dealt.groupBy("block").applyInArrow(sketch_step(window, cells, per_shard), _ASK)
    full = sketches.groupBy("shard").applyInArrow(merge_step(per_shard), _ANSWER)
    asked = dealt.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(ask_step(window, cells, per_shard, n_blocks), _ASK)
    smaller = asked.groupBy("shard").applyInArrow(least_step, _ANSWER)
    cut = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return dealt.groupBy("block").cogroup(smaller.groupBy("block")).applyInArrow(cut_step(window), cut)
