"""Words of Arrow text columns as NumPy arrays: positions and 128-bit names.

A name is two numbers of 64 bits, its lanes.  Words are read eight bytes at a time and mixed after each
step; runs of words are named by mixing the names of their halves.  Both are non-linear in all that
goes in, so neither the structure of a text nor its length makes names equal, and at 10**13 runs two
lanes are equal by chance with a probability of 1e-12.

A batch is worked through in slices of about a MB of text, so that memory follows the slice (or one
very long text), not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Bytes that part words: blank and the control characters from tab to carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 20

_U = np.uint64


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def sparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each next one, and at the end, what the last one needed goes back to the system.

    Workers stay for the next stages, so what they keep counts beside the memory of those.
    """
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)


SEPARATES = np.zeros(256, bool)
SEPARATES[list(SEPARATORS)] = True
#: Bytes that are mixed eight at a time; longer words are named by BLAKE2.
CHUNKED = 64
# Odd multipliers and offsets of the two lanes.
_TIMES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_PLUS = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_KEY = b"quarrylight words"
_UP_TO = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit moves all output bits."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def byte_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """One lane of the name of data[start:end] for each pair; of different words of up to eight bytes no two are equal in any lane."""
    times, plus = _TIMES[lane], _PLUS[lane]
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix(size.astype(_U) * plus + times)
    h = mix((h ^ (eight[starts] & _UP_TO[np.minimum(size, 8)])) * times + plus)
    done = 8
    while (longer := np.flatnonzero((size > done) & (size <= CHUNKED))).size:
        chunk = eight[starts[longer] + done] & _UP_TO[np.minimum(size[longer] - done, 8)]
        h[longer] = mix((h[longer] ^ chunk) * times + plus)
        done += 8
    for i in np.flatnonzero(size > CHUNKED):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=_KEY).digest()
        h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


@dataclass
class Words:
    """The words of some consecutive rows of a batch."""

    first_row: int
    data: np.ndarray  # bytes of the texts, one after the other
    text_at: np.ndarray  # where each text begins in data, and its end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    word_at: np.ndarray  # index of the first word of each row, and the number of words
    _lanes: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return len(self.text_at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def names(self, lane: int = 0) -> np.ndarray:
        """A lane of each word's name."""
        return self._level(1, lane)

    def _level(self, n: int, lane: int) -> np.ndarray:
        """A lane of the name of the n words from each word on, n a power of two; also across rows."""
        if (n, lane) not in self._lanes:
            if n == 1:
                self._lanes[n, lane] = byte_names(self.data, self.starts, self.ends, lane)
            else:
                half = self._level(n // 2, lane)
                self._lanes[n, lane] = mix(half[: -(n // 2)] * _TIMES[lane] + half[n // 2 :])
        return self._lanes[n, lane]

    def begins(self, n: int) -> np.ndarray:
        """The first word of each run of n words that lies in one row."""
        total = len(self.starts)
        inside = np.ones(total, bool)
        for back in range(1, n):  # the last n - 1 words of a row begin no run
            at = self.word_at[1:] - back
            inside[at[at >= self.word_at[:-1]]] = False
        return np.flatnonzero(inside)

    def runs(self, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, a lane of the name) of each run of n words that lies in one row."""
        at = self.begins(n)
        if not len(at):
            return at, np.zeros(0, _U)
        h, done = None, 0
        for power in reversed(range(n.bit_length())):
            if n >> power & 1:
                part = self._level(1 << power, lane)[at + done]
                h = part if h is None else mix(h * _PLUS[lane] + part)
                done += 1 << power
        return at, h

    def whole(self, lane: int = 0) -> np.ndarray:
        """A lane of the name of each row's whole word sequence: the sum of its words, each mixed with its place."""
        place = np.arange(len(self.starts)) - np.repeat(self.word_at[:-1], self.counts)
        sums = np.zeros(len(self.starts) + 1, _U)
        np.cumsum(mix(self.names(lane) ^ mix(place.astype(_U) * _TIMES[lane] + _PLUS[lane])), out=sums[1:])
        return mix(sums[self.word_at[1:]] - sums[self.word_at[:-1]] + self.counts.astype(_U))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(at[0]) if len(at) else 0, int(at[-1]) if len(at) else 0
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return raw, at - lo


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of each slice of a text column; ``lower`` takes A-Z as a-z."""
    raw, at = text_bytes(column)
    for lo, hi in slices(at):
        data, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        data = _LOWER[data] if lower else data
        n = len(data)
        sep = SEPARATES[data]
        edge = np.zeros(n + 1, bool)
        edge[own] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = sep[:-1], sep[1:]
        starts = np.flatnonzero(~sep & (before | edge[:-1]))
        ends = np.flatnonzero(~sep & (after | edge[1:])) + 1
        yield Words(lo, data, own, starts, ends, np.searchsorted(starts, own))
