"""Vectorised work on the bytes of a batch of texts: words, shingles and rolling hashes, in numpy inside a task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE = (_BASE & ~7) | 5
_MASK = (1 << 64) - 1
_SYMBOLS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on the whole of it."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        m = 1 << max(16, (n - 1).bit_length())
        out = np.ones(m, np.uint64)
        have = 1
        while have < m:  # doubling: the second half is the first times a power
            out[have : 2 * have] = out[:have] * np.uint64(pow(step, have, 1 << 64))
            have *= 2
        _powers[kind] = out
    return _powers[kind][:n]


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOLS[data] * _power("up", max(n, 1))[:n], out=self.sums[1:])
        self.n = n

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power("down", self.n + 1)[start] ^ (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position at which k bytes are left."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: self.n - k + 1]) * _power("down", self.n + 1)[: self.n - k + 1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def released(run: Callable) -> Callable:
    """The same work on batches, after which the worker gives the memory it has freed back to the machine: idle workers
    of an earlier stage share an executor's memory with the next stage."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library has no such call elsewhere
                ctypes.CDLL(None).malloc_trim(0)

    return after


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes in ``inside`` (a table of 256), and its text's number."""
    mark = inside[data]
    begin, end = mark.copy(), mark.copy()
    begin[1:] &= ~mark[:-1]
    end[:-1] &= ~mark[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = mark[cut]
    end[cut - 1] = mark[cut - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Per text, its sorted distinct k-word shingles as 64-bit hashes.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of fewer words has its whole sequence
    as its one shingle; a text without words has none.
    """
    data, offsets = flat(texts)
    data = _LOWER[data]
    start, end, row = word_spans(data, offsets, ~_WHITE)
    words = Rolling(data).ranges(start, end) if len(start) else np.zeros(0, np.uint64)
    rows = len(offsets) - 1
    bound = np.searchsorted(row, np.arange(rows + 1))
    n = len(words)
    full = np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    if n >= k:
        full = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            full = full * factor + words[j : n - k + 1 + j]
        full = mix(full)
    out = []
    for r in range(rows):
        a, b = bound[r], bound[r + 1]
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in words[a:b]:
                h = h * factor + x
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
