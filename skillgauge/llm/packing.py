"""Best-fit packing of token sequences by patterns fitted to the length histogram (operator 11).

Documents become token ids with an end id, and pieces of at most `room` ids; only longer documents are cut. All that
packing has to know is how many pieces there are of each length: a histogram of at most `room` numbers,
whatever the corpus. On it, the driver

1. enumerates patterns of up to three pieces that fill a sequence, over lengths rounded up to `grain` ids,
2. fits how often to repeat each by non-negative least squares (an active set, so at most as many patterns as
   rounded lengths are used), short lengths weighing less because they fill gaps anyway,
3. rounds down, as far as there are pieces, and
4. packs the residual pieces best fit, longest first, into the gaps of the sequences so far and into new ones, whole
   counts at a time.

The plan says for every length which ranks go to which sequences and where. Pieces are ranked within
their length by counts per hash bucket and their prefix sums, so no length is gathered in one
task, and looked up in the plan. Its size follows `room`, not the corpus.

Texts are cut into the tokenizer's own units here, and each distinct unit is given to the tokenizer once per task; what is not plain
Latin text goes to it whole, between white space. Ids are the same as for the whole text.

Defined results: a null text is empty and packs as its end id alone; repeated rows are packed each; rows
with null ids are packed and keep the null; an empty table gives an empty table; texts of any length are read in
whole; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from skillgauge.llm.storage import stored
from skillgauge.llm.tokens import slices

#: Ids in a sequence.
ROOM = 4096
#: The id after every document.
END = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Lengths are rounded up to a 256th of a sequence for the fit.
_GRAINS = 256
#: Distinct units that a worker remembers.
_REMEMBERED = 1 << 19
#: Pieces of a hash bucket, about.
_BUCKET = 1 << 15

_LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Texts in which lower-casing and normal form are the same for every library.
_PLAIN = re.compile(rf"[\x09-\x0D\x20-\x7E{_LETTER}]*")
_CHUNK = re.compile(r"[^\x09-\x0D\x20]+")
#: The tokenizer's own pattern, on lower-cased plain text (a fixed value of the vocabulary file).
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-z0-9ß-öø-ÿ]+")


class Units:
    """Token ids of texts by way of their units, as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])

    @staticmethod
    def split(text: str) -> list[str]:
        """Units of a text; one that is not plain starts with a space."""
        if _PLAIN.fullmatch(text):
            return _UNIT.findall(text.lower())
        return [unit for chunk in _CHUNK.findall(text) for unit in (_UNIT.findall(chunk.lower()) if _PLAIN.fullmatch(chunk) else [" " + chunk])]

    def learn(self, units: set[str]) -> None:
        plain = [u for u in units if u[0] != " "]
        for a in range(0, len(plain), 512):
            part = plain[a : a + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not close every unit with a word end")
            raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((unit, raw[a:b]) for unit, a, b in zip(part, bounds, bounds[1:]))
        odd = [u for u in units if u[0] == " "]
        for unit, found in zip(odd, self.tokenizer.encode_batch([u[1:] for u in odd], add_special_tokens=False)):
            self.known[unit] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        split = [self.split(text) for text in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        for units in split:
            yield b"".join(map(self.known.__getitem__, units))


@functools.cache
def _units(path: str) -> Units:
    return Units(path)


def token_pieces(docs: DataFrame, room: int = ROOM, tokenizer: str = TOKENIZER, end: int = END, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document; `tokenizer` is a path every executor has."""
    narrow = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                at, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(units.encode(part.column("text").to_pylist())):
                    ids += last
                    for k, a in enumerate(range(0, len(ids), 4 * room)):
                        cut = ids[a : a + 4 * room]
                        at.append(row)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return narrow.mapInArrow(scan, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Group(NamedTuple):
    """`count` sequences filled alike: `free` ids left, and (length, how many) of what is in them, in order."""

    free: int
    count: int
    filled: tuple[tuple[int, int], ...]


def patterns(histogram: np.ndarray, grains: int) -> np.ndarray:
    """Up to three rounded lengths, 0 for none, that fill `grains` exactly and occur in the histogram."""
    there = histogram > 0
    there[0] = True
    one, two = np.meshgrid(np.arange(1, grains + 1), np.arange(grains + 1), indexing="ij")
    three = grains - one - two
    fits = (one >= two) & (two >= three) & (three >= 0)
    rows = np.stack([one[fits], two[fits], three[fits]], 1)
    return rows[there[rows].all(1)]


def non_negative_fit(columns: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns used and their non-negative repeats that come nearest to the target, by an active set.

    `columns` holds the rounded lengths of each pattern. One column joins at a time, the one with the
    steepest gradient; columns that would turn negative leave again.
    """
    matrix = np.zeros((len(target), len(columns)))
    for k in range(columns.shape[1]):
        np.add.at(matrix, (columns[:, k], np.arange(len(columns))), 1.0)
    matrix[0] = 0
    matrix *= weights[:, None]
    scaled = target * weights
    towards = matrix.T @ scaled
    used = np.empty(0, np.int64)
    repeats = np.empty(0)
    enough = 1e-7 * (1 + np.abs(towards).max(initial=0))
    for _ in range(3 * len(target)):
        gradient = matrix.T @ (scaled - matrix[:, used] @ repeats)
        gradient[used] = 0
        best = int(np.argmax(gradient)) if len(gradient) else 0
        if not len(gradient) or gradient[best] <= enough:
            break
        used, repeats = np.append(used, best), np.append(repeats, 0.0)
        while len(used):
            part = matrix[:, used]
            solved = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(used)), towards[used])
            if (solved > 0).all():
                repeats = solved
                break
            falling = solved <= 0
            step = np.min(repeats[falling] / np.maximum(repeats[falling] - solved[falling], 1e-300))
            repeats = np.maximum(repeats + min(step, 1.0) * (solved - repeats), 0.0)
            gone = falling & (repeats <= 1e-9)
            if not gone.any():
                gone[np.argmin(np.where(falling, repeats, np.inf))] = True
            used, repeats = used[~gone], repeats[~gone]
    return columns[used], repeats


def plan(histogram: np.ndarray, room: int = ROOM, grains: int = _GRAINS) -> list[Group]:
    """Sequences for a histogram of lengths (0 to `room`), by fitted patterns and best fit for the rest."""
    left = histogram.astype(np.int64).copy()
    groups: list[Group] = []
    if left[room]:
        groups.append(Group(0, int(left[room]), ((room, 1),)))
        left[room] = 0
    grain = -(-room // min(grains, room))
    cells = room // grain
    rounded = -(-np.arange(room + 1) // grain)
    coarse = np.bincount(rounded, weights=left, minlength=cells + 2)[: cells + 1]
    # Short pieces weigh little: they fill what the others leave.
    weights = np.where(np.arange(cells + 1) * 8 < cells, 0.1, 1.0)
    found, repeats = non_negative_fit(patterns(coarse, cells), coarse, weights)
    for k in np.argsort(-repeats, kind="stable"):
        groups.extend(_realised(found[k], int(repeats[k]), left, rounded))
    return _best_fit(groups, left, room)


def _realised(pattern: np.ndarray, repeats: int, left: np.ndarray, rounded: np.ndarray) -> list[Group]:
    """Groups of sequences for one pattern; takes the longest pieces of each cell off `left`."""
    cells = [int(c) for c in pattern if c]
    need = {c: cells.count(c) for c in cells}
    lengths = {c: np.flatnonzero(rounded == c)[::-1] for c in need}
    repeats = min([repeats, *(int(left[lengths[c]].sum()) // n for c, n in need.items())])
    room = len(left) - 1
    groups = []
    while repeats > 0:
        # All places of a cell take the same length as long as it lasts; one piece at a time where it runs out.
        chosen, step = [], repeats
        taken: dict[int, int] = {}
        for c in cells:
            length = next(int(x) for x in lengths[c] if left[x] - taken.get(int(x), 0) > 0)
            taken[length] = taken.get(length, 0) + 1
            chosen.append(length)
        for length, n in taken.items():
            step = min(step, int(left[length]) // n)
        for length, n in taken.items():
            left[length] -= step * n
        repeats -= step
        groups.append(Group(room - sum(chosen), step, tuple((x, 1) for x in chosen)))
    return groups


def _best_fit(groups: list[Group], left: np.ndarray, room: int) -> list[Group]:
    """All pieces left, longest first, each into the sequence with the least room that suffices; whole counts at a time."""
    by_free: list[list[Group]] = [[] for _ in range(room + 1)]
    filled = np.zeros(room + 2, np.int64)
    for g in groups:
        by_free[g.free].append(g)
        filled[g.free] += 1

    def put(g: Group) -> None:
        by_free[g.free].append(g)
        filled[g.free] += 1

    for length in np.flatnonzero(left)[::-1].tolist():
        count, at = int(left[length]), length
        while count:
            while at <= room and not filled[at]:
                at += int(np.argmax(filled[at:] > 0)) if filled[at:].any() else room + 1 - at
            if at > room:
                each = room // length
                whole, some = divmod(count, each)
                if whole:
                    put(Group(room - each * length, whole, ((length, each),)))
                if some:
                    put(Group(room - some * length, 1, ((length, some),)))
                break
            g = by_free[at].pop()
            filled[at] -= 1
            # The sequence just filled is the best fit for the next piece of this length, too.
            each = min(at // length, count)
            whole = min(g.count, count // each)
            put(Group(at - each * length, whole, (*g.filled, (length, each))))
            if g.count > whole:
                put(Group(at, g.count - whole, g.filled))
            count -= whole * each
    return [g for groups_of in by_free for g in groups_of]


def _places(groups: list[Group], room: int) -> dict[str, np.ndarray]:
    """The plan by length: ranks from `rank` on go, `each` to a sequence, to sequences from `sequence` on, at `offset`."""
    rows = []
    ranks = np.zeros(room + 1, np.int64)
    sequence = 0
    for g in groups:
        offset = 0
        for length, each in g.filled:
            rows.append((length, int(ranks[length]), each, sequence, offset))
            ranks[length] += each * g.count
            offset += each * length
        sequence += g.count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), columns))


def _ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with rank: their number among those of their length, from 0.

    A length may hold any part of the corpus, so ranks are counted within hash buckets of it, whose starts are
    prefix sums over the buckets.
    """
    n_buckets = max(1, -(-pieces.count() // _BUCKET))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = spread.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(starts, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("bucket", "nth", "before")


def pack(docs: DataFrame, room: int = ROOM, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place."""
    session = docs.sparkSession
    pieces = stored(token_pieces(docs, room, **options), "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    histogram = np.zeros(room + 1, np.int64)
    histogram[counts.column("length").to_numpy()] = counts.column("n").to_numpy()
    held = session.sparkContext.broadcast(_places(plan(histogram, room), room))
    width = int(histogram.max(initial=0)) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        order = places["length"] * width + places["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, length * width + rank, side="right") - 1
            beyond, within = np.divmod(rank - places["rank"][at], places["each"][at])
            added = [pa.array(places["sequence"][at] + beyond), pa.array(places["offset"][at] + within * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added], names=[*_PIECE, "sequence_id", "offset"])

    ranked = _ranked(pieces).select(*_PIECE, "rank")
    return ranked.mapInArrow(scan, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
