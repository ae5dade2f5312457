"""Questions from blocks of documents to shards of hashes, and the answers.

Counting something for every word or window of a corpus by rows would move one row per occurrence.
Here documents are dealt out to blocks of bounded size; a block asks about each of its distinct hashes
once, all hashes that belong to one shard in one packed row, and the shard answers in the same order.
Hot hashes cost one entry per block, whatever their number. Spark deals out blocks, questions and
answers; a task holds one block or one shard at a time.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Text in one block, on average; a longer document is a block by itself at worst.
BLOCK_BYTES = 8 << 20
_BLOCKS_PER_TASK = 16


def plan_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """How many bytes of text there are, and how many blocks that makes."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")).alias("n")).first()["n"] or 0
    return size, max(1, -(-size // block_bytes))


def in_blocks(docs: DataFrame, n_blocks: int, id_column: str, text: str, *more: Column) -> DataFrame:
    """block, doc_id, text and `more`, dealt out by block; equal rows share a block."""
    narrow = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text}`")), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        *more,
    )
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(min(n_blocks, max(usual, n_blocks // _BLOCKS_PER_TASK)), "block")


def shard_bounds(n_shards: int) -> np.ndarray:
    """The first hash of every shard but the first."""
    return np.array([(k << 64) // n_shards for k in range(1, n_shards)], np.uint64)


def by_shard(sorted_hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the non-empty shards of a sorted array."""
    cuts = np.concatenate([[0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]])
    return [(int(shard), int(cuts[shard]), int(cuts[shard + 1])) for shard in np.flatnonzero(cuts[1:] > cuts[:-1])]


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers byte plane by byte plane, planes of zeros left out, compressed."""
    wide = np.ascontiguousarray(values, np.uint64)
    n_planes = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :n_planes].T)
    return np.array([len(wide), n_planes], np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    n, n_planes = (int(x) for x in np.frombuffer(packed, np.uint32, 2))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:], max_output_size=n * n_planes), np.uint8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :n_planes] = planes.reshape(n_planes, n).T
    return wide.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array by its steps."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(packed), dtype=np.uint64)


def contained(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def joined(*parts: bytes) -> bytes:
    """Several byte strings as one, with their lengths before them."""
    return np.array([len(part) for part in parts], np.uint32).tobytes() + b"".join(parts)


def parted(payload: bytes, n: int) -> list[bytes]:
    """The n byte strings of `joined`."""
    sizes = np.frombuffer(payload, np.uint32, n)
    ends = 4 * n + np.cumsum(sizes)
    return [payload[end - size : end] for size, end in zip(sizes.tolist(), ends.tolist())]
