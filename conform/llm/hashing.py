"""Vectorised words and word-window hashes over Arrow text columns (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step handles; only a single longer word makes a step larger.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))

            def series(b: int) -> np.ndarray:
                s = np.full(size, b, np.uint64)
                s[0] = 1
                return np.multiply.accumulate(s)

            self._up, self._down = series(self.base), series(self.inverse)
        return self._up[:n], self._down[:n]


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xD6E8FEB86659FD93)


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """A 256-entry table: True for bytes inside the ranges (outside them if ``invert``)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return ~table if invert else table


#: Words are what stands between ASCII white space.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: Words are runs of digits, ASCII letters and non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
PLAIN = np.arange(256)
#: A-Z read as a-z.
LOWER = np.where((PLAIN >= 0x41) & (PLAIN <= 0x5A), PLAIN + 32, PLAIN)


@dataclass
class Words:
    """All words of a block of texts in order: byte range, text number and 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def text_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, joined, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words_of(column: pa.Array, keep: np.ndarray, fold: np.ndarray = PLAIN, seed: int = 0) -> Words:
    """Find and hash the words of every text. ``keep`` says which bytes belong to words; ``fold`` maps bytes before hashing."""
    data, off = text_bytes(column)
    m = keep[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edges = off[:-1][off[:-1] < off[1:]]
    first[edges] = m[edges]
    edges = off[1:][off[:-1] < off[1:]] - 1
    last[edges] = m[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    values = random_words(256, seed)[fold]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP_BYTES, "right")))
        lo, hi = start[i], end[j - 1]
        up, down = BYTE_POWERS.get(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up, out=sums[1:])
        out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return Words(data, start, end, doc, mix(out), len(off) - 1)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of ``k`` words inside one text: (first word's index, hash)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = WORD_POWERS.get(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return at, mix((sums[at + k] - sums[at]) * down[at])


def covered(at: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` words that starts at one of ``at``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the maximal runs of True that stay inside one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    first = mask & (new | ~np.concatenate(([False], mask[:-1])))
    end_doc = np.concatenate((new[1:], [True]))
    last = mask & (end_doc | ~np.concatenate((mask[1:], [False])))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def blocks(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a longer text is a range of its own."""
    _, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
