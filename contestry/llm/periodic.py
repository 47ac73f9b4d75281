"""Periodic runs in the words of a text, found by string synchronising sets, and texts without their repeats.

A run is a stretch of words with smallest period q, at least ``repeats`` (3 or more) periods and ``min_length``
words long, that no neighbouring word extends. Words are what white space leaves, compared as they are.

At a dyadic scale w = 8, 16, ... a position is *synchronising* if, of the windows of w words that start at it
and at the w positions after it, the least hash belongs to the first or the last. That depends on 2w words
only, so repeats of a passage carry the same positions. Windows with a period of w/3 or less have no hash:
they lie in runs that smaller scales have found already, and the synchronising positions beside these regions
stand for them (periods below 16 are found by comparing words that far apart). Of the synchronising positions
of a text, neighbours with equal contexts of 3w or of 4w words propose their distance, 2w to 4w, as a period;
it is extended to both sides by comparing hashes, and what is left is checked word by word.

No run is missed. Let a run have period q in [2w, 4w] and start at s. Its first synchronising position i is at
most s + max(w, q - 5w/3): without one in the first w positions the run starts in a region of period w/3 or
less, which is shorter than q + w/3 (else q were no smallest period), and there is one in that region some 2w words before its end.
A context of L words, q <= L <= min(q + 5w/3, 2q - w), is at i and at i + q, both within three periods,
and nowhere between as q is the smallest period. L = 3w serves for q up to 3w, L = 4w for the others.

Hashes of contexts are pairs of polynomials modulo primes near 2^31: two contexts differ unseen with a chance
of some 2^-62. The work grows with words times the logarithm of the longest text. Rows are worked where they
are read, in batches of some ``BATCH`` bytes or one longer text (some 150 bytes of memory a word); nothing is
shuffled. A null or empty text has no words, no runs and an empty result. Rows repeat as they come; a null
doc_id stays null; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.words import SPACE, mix, pieces, text_bytes

MIN_LENGTH, REPEATS = 24, 3
BATCH = 4 << 20
_SMALL = 8  # the least scale; periods below twice of it are compared directly
_PRIMES = ((2147483647, 1103515245), (2147483629, 1664525137))  # a prime and the base of its polynomial
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Powers:
    """Powers of a base and of its inverse modulo a prime, grown as needed."""

    def __init__(self, prime: int, base: int):
        self.prime = prime
        self.base, self.inverse = base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.int64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * pow(self.base, k, self.prime) % self.prime])
            self.down = np.concatenate([self.down, self.down * pow(self.inverse, k, self.prime) % self.prime])


class Finder:
    """Finds the runs of many texts at once. Texts are sequences of integers, one behind the other."""

    def __init__(self, min_length: int = MIN_LENGTH, repeats: int = REPEATS):
        if repeats < 3:
            raise ValueError("the completeness of the search needs three periods")
        self.min_length, self.repeats = min_length, repeats
        self.powers = [_Powers(*p) for p in _PRIMES]

    def __call__(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, start in the text, length, period), by text, start and period."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")  # the texts long enough for a scale come first
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        where = np.repeat(offsets[:-1][order] - starts, sizes) + np.arange(len(x))
        self.x, self.text = x[where], np.repeat(np.arange(len(sizes)), sizes)
        self.start, self.end = starts[self.text], (starts + sizes)[self.text]
        self._prefixes()
        found = [self._direct(q) for q in range(1, 2 * _SMALL)]
        runs = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
        w = _SMALL
        while len(sizes) and sizes[0] >= 6 * w:
            m = int(sizes[sizes >= 6 * w].sum())
            new = self._scale(w, m, runs)
            if len(new):
                runs = _smallest(np.concatenate([runs, new]))
            w *= 2
        s, e, q = runs.T
        keep = e - s >= np.maximum(self.min_length, self.repeats * q)
        s, e, q = s[keep], e[keep], q[keep]
        t = self.text[s] if len(s) else s
        out = np.stack([order[t] if len(s) else s, s - starts[t] if len(s) else s, e - s, q], 1)
        return out[np.lexsort(out.T[::-1])]

    def _prefixes(self) -> None:
        n = len(self.x)
        values = mix((self.x + 1).astype(np.uint64)) >> np.uint64(33)
        self.sums = []
        for p in self.powers:
            p.grow(n + 1)
            total = np.zeros(n + 1, np.int64)
            np.cumsum(values.astype(np.int64) % p.prime * p.up[:n] % p.prime, out=total[1:])
            total %= p.prime
            self.sums.append(total)

    def _hash(self, at, length) -> np.ndarray:
        """The hash of ``length`` words from each position; ``at`` may be a slice."""
        to = slice(at.start + length, at.stop + length) if isinstance(at, slice) else at + length
        a, b = ((h[to] - h[at]) % p.prime * p.down[at] % p.prime for p, h in zip(self.powers, self.sums, strict=True))
        return (a << 31 | b).astype(np.uint64)

    def _direct(self, q: int) -> np.ndarray:
        """All stretches of period q of three periods or more."""
        n = len(self.x)
        if n <= q:
            return np.zeros((0, 3), np.int64)
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = (self.x[:-q] == self.x[q:]) & (np.arange(q, n) < self.end[:-q])
        step = np.diff(same)
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        keep = e - s >= 2 * q
        return np.stack([s[keep], e[keep] + q, np.full(int(keep.sum()), q)], 1)

    def _scale(self, w: int, m: int, runs: np.ndarray) -> np.ndarray:
        """Runs with periods from 2w to 4w in the first m words."""
        n = m - w + 1
        f = mix(self._hash(slice(0, n), w))
        at = np.arange(n)
        f[at + w > self.end[:n]] = _NONE
        flat = runs[(3 * runs[:, 2] <= w) & (runs[:, 1] - runs[:, 0] >= w) & (runs[:, 1] <= m)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, flat[:, 0], 1)
        np.add.at(edge, flat[:, 1] - w + 1, -1)
        f[np.cumsum(edge[:n]) > 0] = _NONE
        least, k = f, 1
        while k < w:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        n = m - 2 * w + 1
        least = np.minimum(least[:n], f[w : w + n])
        chosen = np.flatnonzero(((f[:n] == least) | (f[w : w + n] == least)) & (least != _NONE) & (at[:n] + 2 * w <= self.end[:n]))
        pairs = []
        for length in (3 * w, 4 * w):
            c = chosen[chosen + length <= self.end[chosen]] if len(chosen) else chosen
            if len(c) < 2:
                continue
            key = mix(self._hash(c, length)) ^ mix(self.text[c].astype(np.uint64) + np.uint64(1))
            by = np.argsort(key, kind="stable")
            key, c = key[by], c[by]
            a, d = c[:-1], np.diff(c)
            near = (key[:-1] == key[1:]) & (self.text[a] == self.text[c[1:]]) & (d >= 2 * w) & (d <= 4 * w)
            pairs.append(np.stack([a[near], d[near]], 1))
        if not pairs or not sum(map(len, pairs)):
            return np.zeros((0, 3), np.int64)
        i, d = np.unique(np.concatenate(pairs), axis=0).T
        return self._extended(i, d)

    def _extended(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The longest stretches of period d around the equal words at i and i + d, of three periods or more."""
        room, behind = self.end[i] - i - d, i - self.start[i]
        right, left = np.zeros_like(i), np.zeros_like(i)
        step = 1 << int(max(room.max(), behind.max(), 1)).bit_length()
        while step:
            for go, limit, sign in ((right, room, 1), (left, behind, -1)):
                at = np.flatnonzero(go + step <= limit)
                a = i[at] + go[at] if sign > 0 else i[at] - go[at] - step
                go[at] += step * (self._hash(a, step) == self._hash(a + d[at], step))
            step >>= 1
        out = np.stack([i - left, i + d + right, d], 1)
        distinct = np.unique(out[out[:, 1] - out[:, 0] >= 3 * out[:, 2]], axis=0)
        if not all(self._holds(*r) for r in distinct.tolist()):
            out = np.array([self._walk(*r) for r in zip(i.tolist(), d.tolist(), strict=True)], np.int64)
            distinct = np.unique(out[out[:, 1] - out[:, 0] >= 3 * out[:, 2]], axis=0)
        return distinct

    def _holds(self, s: int, e: int, q: int) -> bool:
        """Whether the words are as the hashes say, and the stretch as long as it gets."""
        x = self.x
        ends = (s == self.start[s] or x[s - 1] != x[s - 1 + q]) and (e == self.end[s] or x[e] != x[e - q])
        return bool(ends) and np.array_equal(x[s : e - q], x[s + q : e])

    def _walk(self, i: int, q: int) -> tuple[int, int, int]:
        """The stretch around i by the words themselves."""
        lo, hi = int(self.start[i]), int(self.end[i])
        after = np.flatnonzero(self.x[i : hi - q] != self.x[i + q : hi])
        before = np.flatnonzero(self.x[lo:i] != self.x[lo + q : i + q])
        return (lo + int(before[-1]) + 1 if len(before) else lo, i + q + int(after[0]) if len(after) else hi, q)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) on one stretch the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, offsets of each text's words)."""
    data, offsets = text_bytes(texts)
    space = np.zeros(256, bool)
    space[[ord(c) for c in SPACE]] = True
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(full[1:-1] & (~full[:-2] | first[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | first[1:])) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[full[1:-1]].tobytes())])
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def _runner(min_length, repeats):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        find = Finder(min_length, repeats)
        for batch in pieces(batches, "text", BATCH):
            words, offsets = split_words(batch.column("text"))
            n = batch.num_rows
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            text, start, length, period = find(ids, offsets).T
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, offsets[text] + start + period, 1)
            np.add.at(edge, offsets[text] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            parts = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, offsets)), words.take(pa.array(kept)))
            collapsed = pc.binary_join(parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            rows = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), rows).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, repeats: int = REPEATS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and its words without repeats.

    ``collapsed`` leaves out every word that any run holds after its first period, and joins the rest by single spaces.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(_runner(min_length, repeats), RUNS)
