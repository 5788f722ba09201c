"""Sets of word shingles, their MinHash samples and odd sketches, in NumPy."""

from __future__ import annotations

import numpy as np

from .wordhash import Words, mix

_U = np.uint64
N_SAMPLES = 512
SKETCH_BITS = 1024
_rng = np.random.default_rng(5)
_FLIP = _rng.integers(0, 1 << 32, N_SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, N_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the names of each row's distinct shingles, sorted by the first within the row, and where each row's begin.

    A row with fewer than n words has its whole sequence as its only shingle; one without words has none.
    """
    at, h = w.runs(n)
    g = w.runs(n, 1)[1]
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < n))
    row = np.searchsorted(w.word_at, at, "right") - 1
    if len(few):
        row, h, g = np.concatenate([row, few]), np.concatenate([h, w.whole()[few]]), np.concatenate([g, w.whole(1)[few]])
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    row, h, g = row[order], h[order], g[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        row, h, g = row[new], h[new], g[new]
    return h, g, np.searchsorted(row, np.arange(w.rows + 1))


def samples(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash samples of each row's set; rows without shingles get the largest number."""
    out = np.full((len(at) - 1, N_SAMPLES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        low = (h >> _U(32)).astype(np.uint32)
        begins = at[full]
        for i in range(N_SAMPLES):
            x = (low ^ _FLIP[i]) * _TIMES[i]
            out[full, i] = np.minimum.reduceat(x, begins)
    return out


def bands(s: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """A key of each band of samples."""
    out = np.zeros((len(s), n_bands), _U)
    for b in range(n_bands):
        k = np.full(len(s), b + 1, _U)
        for r in range(n_rows):
            k = mix(k * _U(0x9E3779B97F4A7C15) + s[:, b * n_rows + r].astype(_U))
        out[:, b] = k
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits per row as 64-bit words: each sample flips the bit it hashes to."""
    rows = len(s)
    bit = mix(s.astype(_U) * _U(N_SAMPLES) + np.arange(N_SAMPLES, dtype=_U)) % _U(SKETCH_BITS)
    at = (np.arange(rows, dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(at, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8).reshape(rows, SKETCH_BITS)
    return np.packbits(odd, axis=1).view(_U).reshape(rows, SKETCH_BITS // 64)


def fingerprint(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers, one of each lane, that are equal for equal sets."""
    out = []
    for lane, salt in ((h, 0x51ED270B), (g, 0xC2B2AE3D)):
        sums = np.zeros(len(lane) + 1, _U)
        np.cumsum(mix(lane + _U(salt)), out=sums[1:])
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out[0], out[1]
