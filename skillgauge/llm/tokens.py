"""Words of Arrow string columns as 64-bit hashes, by whole-array operations.

A word is a run of bytes that are not ASCII white space; its hash depends on its bytes only. Hashes of
word sequences combine word hashes. Work arrays cover a bounded stretch of text at a time, so memory
does not follow the longest document but for one number per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_STRETCH = 1 << 18


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    """An independent-looking hash of hashes for every salt."""
    with np.errstate(over="ignore"):
        return _mixed(values ^ _mixed(np.array([salt + 1], np.uint64) * _BASE))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = np.empty(0, np.uint64)
        self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up), 2 * _STRETCH)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", np.uint64(_inverse(int(_BASE))))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


_POWERS = _Powers()
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = salted(np.arange(256, dtype=np.uint64), 7)
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each string starts; one more for the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Words of several texts: `hashes`, byte range `starts`:`ends`, and `first`, the word at which each text begins."""

    def __init__(self, texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> None:
        """`separator` says of each byte value whether it stands between words."""
        self.data, self.bounds = bytes_of(texts)
        inside = ~separator[self.data]
        begins, finishes = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            finishes[:-1] &= ~inside[1:]
            filled = self.bounds[1:] > self.bounds[:-1]
            heads, tails = self.bounds[:-1][filled], self.bounds[1:][filled] - 1
            begins[heads] |= inside[heads]
            finishes[tails] |= inside[tails]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.hashes = self._hashed(_LOWER_VALUE if lower else _VALUE)

    def _hashed(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(self.data) + _STRETCH, _STRETCH)))
        with np.errstate(over="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:]):
                left, right = self.starts[a], self.ends[b - 1]
                _POWERS.upto(int(right - left) + 1)
                sums = np.zeros(right - left + 1, np.uint64)
                np.cumsum(values[self.data[left:right]] * _POWERS.up[: right - left], out=sums[1:])
                begin, end = self.starts[a:b] - left, self.ends[a:b] - left
                out[a:b] = _mixed((sums[end] - sums[begin]) * _POWERS.down[begin] + (end - begin).astype(np.uint64) * _WORD_BASE)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; n - 1 fewer than entries."""
    size = max(len(hashes) - n + 1, 0)
    out = np.full(size, np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _WORD_BASE + hashes[k : k + size]
        return _mixed(out)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each text, the word each starts at, and its text."""
    owner = words.owners()
    hashes = sequences(words.hashes, n)
    starts = np.flatnonzero(owner[: len(hashes)] == owner[n - 1 :][: len(hashes)]) if len(hashes) else np.empty(0, np.int64)
    return hashes[starts], starts, owner[starts]


def slices(batch: pa.RecordBatch | pa.Table, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive rows holding about `size` bytes of text; a longer text stands alone."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        upto = max(int(np.searchsorted(ends, done + size, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto
