"""MinHash signatures of word shingles, their bands, and exact shingle sets, in vectorised numpy.

Each permutation is a multiply-add-shift hash, universal over 64-bit keys, and the signature keeps its least value. A
text without a word has no signature: it resembles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textblocks import blocks, distinct, mix, offsets, shingles, tokens


@dataclass(frozen=True)
class Scheme:
    """Shingles of ``words`` words; ``bands`` bands of ``rows`` permutations."""

    words: int
    bands: int
    rows: int
    seed: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, self.size, dtype=np.uint64)


def signatures(texts: pa.Array, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as rows x size of uint32, whether the row has one)."""
    a, b = scheme.coefficients()
    sig, some = np.zeros((len(texts), scheme.size), np.uint32), np.zeros(len(texts), bool)
    for first, _, data, off in blocks(texts):
        g, rows = shingles(*tokens(data, off), scheme.words)
        if not len(g):
            continue
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        at = first + rows[starts]
        some[at] = True
        v = np.empty_like(g)
        for j in range(scheme.size):
            np.multiply(g, a[j], out=v)
            np.add(v, b[j], out=v)
            sig[at, j] = np.minimum.reduceat(v, starts) >> np.uint64(32)
    return sig, some


def band_keys(sig: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A key of each band, rows x bands of int64, not negative; keys of different bands differ, and are in their order."""
    bits = max(1, (scheme.bands - 1).bit_length())
    out = np.empty((len(sig), scheme.bands), np.uint64)
    for b in range(scheme.bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for j in range(b * scheme.rows, (b + 1) * scheme.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
        out[:, b] = (h >> np.uint64(bits + 1)) | np.uint64(b << (63 - bits))
    return out.view(np.int64)


def sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    out: list[np.ndarray] = []
    for first, end, data, off in blocks(texts):
        g, rows = distinct(*shingles(*tokens(data, off), words))
        cut = offsets(rows, end - first)
        out += [g[cut[k] : cut[k + 1]] for k in range(end - first)]
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted distinct arrays; 0 if both are empty."""
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def lists(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows x n as an Arrow list column, null where ``some`` is false."""
    n = values.shape[1]
    off = np.append(0, np.cumsum(np.where(some, n, 0))).astype(np.int32)
    flat = pa.array(np.ascontiguousarray(values[some]).ravel())
    return pa.ListArray.from_arrays(pa.array(off), flat, mask=pa.array(~some))


def binaries(values: np.ndarray) -> pa.Array:
    """Rows x n bytes as an Arrow binary column."""
    n = values.shape[1]
    off = pa.array(np.arange(len(values) + 1, dtype=np.int32) * n)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, off.buffers()[1], pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def ragged(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())
