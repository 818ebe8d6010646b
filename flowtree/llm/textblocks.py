"""Vectorised word hashing over Arrow string columns.

Texts are handled as one UTF-8 byte buffer with row offsets, in blocks of about one megabyte, so no Python object
is made per word. Tokens are runs of bytes of one class: letters, digits and all non-ASCII bytes form words, white
space separates, and other ASCII characters separate too or form tokens of their own. Words are hashed by a rolling
polynomial over 64 bits, read off a cumulative sum, and then mixed.

Defined results: a null text counts as empty and has no token; a text of fewer than n tokens, but at least one, has
a single shingle, the whole of it; invalid UTF-8 is replaced before lower-casing. A text of any length is processed
whole; memory per worker is bounded by the block size or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a block, and of a stretch of it that is hashed at a time; a longer token is a stretch.
BLOCK, STRETCH = 1 << 20, 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)
_LETTERS = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def _classes(punctuation: int) -> np.ndarray:
    table = np.full(256, punctuation, np.uint8)
    table[:33] = 0
    table[127] = 0
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[low:high] = 1
    return table


#: Words alone, or words and runs of punctuation.
WORDS, WORDS_AND_MARKS = _classes(0), _classes(2)


class _Kept(dict):
    """A process's own cache: it is empty wherever it is sent, so that it doesn't travel with functions."""

    def __reduce__(self):
        return _Kept, ()


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = _Kept()


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size in _kept:
        return _kept[size]
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == STRETCH:
        _kept[size] = made
    return made


def trimmed(run: Callable) -> Callable:
    """``run``, a function of batches, such that its process gives back the memory that it no longer needs at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; works on its own copy."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(32)
    return h


def lowered(texts: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
        return pa.array([b.decode("utf-8", "replace").lower() for b in raw.to_pylist()], pa.string())


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = True, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets of rows + 1) of consecutive rows of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = pc.fill_null(texts.slice(first, end - first), "")
        if lower:
            part = lowered(part)
        kind = np.int64 if pa.types.is_large_string(part.type) else np.int32
        off = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        yield first, end, data, off - off[0]
        first = end


def tokens(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORDS, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, row) of each token of a block, in order; with ``prefix``, also the hash of its first bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(0, np.int64), none) if prefix else (none, np.zeros(0, np.int64))
    kind = table[data]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[off[:-1][off[:-1] < n]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    real = kind[begins] != 0
    begins, ends = begins[real], ends[real]
    rows = np.searchsorted(off, begins, side="right") - 1
    full, heads = np.empty(len(begins), np.uint64), np.empty(len(begins) if prefix else 0, np.uint64)
    i = 0
    while i < len(begins):  # as much at a time as stays in the processor's cache
        a = begins[i]
        k = max(i + 1, int(np.searchsorted(ends, a + STRETCH, side="right")))
        z = ends[k - 1]
        up, down = _powers(max(STRETCH, 1 << int(z - a).bit_length()))
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_LETTERS[data[a:z]] * up[: z - a], out=sums[1:])
        b, e = begins[i:k] - a, ends[i:k] - a
        full[i:k] = (sums[e] - sums[b]) * down[b]
        if prefix:
            heads[i:k] = (sums[np.minimum(e, b + prefix)] - sums[b]) * down[b]
        i = k
    return (mix(full), rows, mix(heads + _U(prefix))) if prefix else (mix(full), rows)


def shingles(h: np.ndarray, rows: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n tokens within a row. ``whole``: a row of fewer tokens has one, all of it."""
    if not len(h):
        return h, rows

    def joined(at: np.ndarray | slice, size: int, count: int) -> np.ndarray:
        g = np.full(count, size, np.uint64)
        for k in range(size):
            g *= _STEP
            g += h[at + k] if isinstance(at, np.ndarray) else h[k : k + count]
        return mix(g)

    count = max(0, len(h) - n + 1)
    inside = rows[n - 1 :] == rows[:count] if count else np.zeros(0, bool)
    out, owner = joined(slice(None), n, count)[inside], rows[:count][inside]
    if whole and n > 1:
        firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        sizes = np.diff(np.append(firsts, len(rows)))
        extra, of = [out], [owner]
        for size in range(1, n):
            at = firsts[sizes == size]
            if len(at):
                extra.append(joined(at, size, len(at)))
                of.append(rows[at])
        if len(extra) > 1:
            out, owner = np.concatenate(extra), np.concatenate(of)
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
    return out, owner


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once a row, sorted by row and hash."""
    if not len(h):
        return h, rows
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    h, rows = h[order], rows[order]
    new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))
    return h[new], rows[new]


def offsets(rows: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` rows begins in a row-sorted array, and its end."""
    return np.searchsorted(rows, np.arange(count + 1))
