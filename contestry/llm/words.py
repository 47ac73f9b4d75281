"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

White space is the six ASCII characters of ``[\\x20\\x09-\\x0D]``; A-Z fold to lower case and every other
byte counts as it is. A null text is an empty one. A hash is a polynomial in the word's bytes, so it
falls out of running sums; memory is bounded by ``CHUNK`` bytes of text at a time (or one longer word).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = " \t\n\x0b\x0c\r"
#: The same class for Java and Python patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes words of text columns. ``fold`` folds A-Z; ``prefixes`` are lengths in bytes of beginnings to hash as well."""

    def __init__(self, fold: bool = True, prefixes: tuple[int, ...] = ()):
        self.prefixes = prefixes
        space = np.zeros(256, bool)
        space[[ord(c) for c in SPACE]] = True
        self.space = space
        value = np.arange(1, 257, dtype=_U)
        if fold:
            value[65:91] = value[97:123]
        self.value = value
        self.up = self.down = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up = _powers(_BASE, n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word in order, offsets of each text's words: one more than texts).

        With ``prefixes`` the hashes have a column for the word and one for each prefix; a shorter word is its own prefix.
        """
        data, offsets = text_bytes(texts)
        n = len(data)
        if not n:
            return np.zeros((0, 1 + len(self.prefixes)) if self.prefixes else 0, _U), np.zeros(len(offsets), np.int64)
        gap = self.space[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = gap[:-1]
        starts = np.flatnonzero(~gap & (before | first[:n]))
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = gap[1:]
        ends = np.flatnonzero(~gap & (after | first[1:])) + 1
        out = np.empty((len(starts), 1 + len(self.prefixes)), _U)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            self._grow(b - a + 1)
            run = np.zeros(b - a + 1, _U)
            np.cumsum(self.value[data[a:b]] * self.up[: b - a], out=run[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            for c, length in enumerate((0, *self.prefixes)):
                stop = np.minimum(e, s + length) if length else e
                out[i:j, c] = (run[stop] - run[s]) * self.down[s] + _U(c)
            i = j
        return mix(out if self.prefixes else out[:, 0]), np.searchsorted(starts, offsets).astype(np.int64)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1])
        at = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(sizes) // limit]))) + 1
        edges = [0, *[int(x) for x in at if x < batch.num_rows], batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def give_back() -> None:
    """Hand freed memory back to the system. A Python worker outlives its task, and executors count what it keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)
