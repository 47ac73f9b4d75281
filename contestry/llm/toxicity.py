"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings of a few lengths, so a new
word made on a known stem is met half way. Filters of several widths run over the word vectors, each is
max-pooled over the whole text, and a linear layer on the pooled, rectified values gives the logit. One
embedding dimension starts from the log odds of its feature in all training rows; everything is then
trained on the logistic loss (Adam, and Adagrad for the embeddings that a batch meets), whose gradient
reaches only the pooled positions.

A threshold is chosen for each language on training rows that the weights did not see, and the logit is
shifted by it, so that 0.5 is the threshold everywhere. The language is guessed from the text alone, by its
function words: no column but the text is an input of a score.

The fit takes every labelled row. Rows are dealt by their hash to shards of about ``SHARD`` and encoded once, as blocks
that tasks read one at a time. An epoch starts every shard from one model and averages theirs: dense parts over
all shards, an embedding over the shards that met it, in whole numbers, so that the order of sums does not
matter. The model has a fixed size, and it alone passes through the driver, with counts. The thresholds come from
all rows kept for them, by running counts over their ordered logits. Every text is scored whole, where it is read, without a shuffle.

Null and empty texts get the score of no words. Rows without a label are scored, not learned from; null
labels are skipped; a document labelled twice counts as toxic if any label says so. Repeated rows get equal
scores. With no labelled rows of both classes every score is 0. Empty tables give empty results. Extra
columns are ignored by :func:`predictions` and kept by :func:`keep_rows`, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from contestry.llm.words import Words, give_back, pieces
from contestry.session import Stage

#: Labelled rows that one model is trained on before models are averaged, and the ranges of features in which they are.
SHARD, SLICES = 1 << 13, 64
#: Text in a block, in bytes.
BLOCK = 1 << 20
#: Averages are sums of whole numbers of this part of one; a value averaged is at most 127.
UNIT = float(1 << 24)
#: Steps that count as one in an average.
STEPS = 1 << 12
PREFIXES = (3, 4, 5, 6)
TABLE, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
PART = 1 << 16
#: Frequent function words that tell four languages apart; a text is of the one it has most of.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with by this are from".split(),
    "de": "der die und den von zu das mit sich des auf ist im dem nicht".split(),
    "fr": "le et les des un du que une est dans qui pour par sur au".split(),
    "es": "el y los se del las un por con una su para es lo como".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows that labels are never learned from. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


class Features:
    """Hashed features of the words of texts and the guessed language of each text."""

    def __init__(self):
        self.words = Words(prefixes=PREFIXES)
        names = [w for lang in FUNCTION_WORDS.values() for w in lang]
        self.known = np.sort(self.words(pa.array(names))[0][:, 0])
        place = np.searchsorted(self.known, self.words(pa.array(names))[0][:, 0])
        self.votes = np.zeros((len(names), len(LANGUAGES)), np.int32)
        self.votes[place, [i for i, lang in enumerate(FUNCTION_WORDS.values()) for _ in lang]] = 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature numbers for each word, word offsets, language number of each text)."""
        hashes, offsets = self.words(texts)
        at = np.minimum(np.searchsorted(self.known, hashes[:, 0]), len(self.known) - 1)
        found = np.flatnonzero(self.known[at] == hashes[:, 0])
        text = np.searchsorted(offsets, found, "right") - 1
        counts = np.zeros((len(texts), len(LANGUAGES)), np.int32)
        np.add.at(counts, text, self.votes[at[found]])
        guess = np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES) - 1)
        # A feature's kind is part of its hash; number 0 is kept for padding.
        return (hashes % np.uint64(TABLE - 1) + np.uint64(1)).astype(np.int32), offsets, guess.astype(np.int32)


class Network:
    """The convolutional classifier: hashed embeddings, filters of several widths, max pooling, a linear layer."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {"embedding": r.normal(0, 0.05, (TABLE, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.p["shift"] = np.array([-2.0], np.float32)
        self.p["embedding"][0] = 0
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def forward(self, features: np.ndarray, offsets: np.ndarray, with_places: bool = False):
        """(logits, pooled values, places of the maxima); every text is padded by the widest filter less one, and an empty one is a word of padding."""
        pad = max(WIDTHS) - 1
        n = np.diff(offsets)
        room = np.maximum(n, 1) + pad
        starts = np.cumsum(room) - room
        rows = np.zeros((int(room.sum()) + pad, features.shape[1]), np.int32)
        inside = np.repeat(starts - offsets[:-1], n) + np.arange(offsets[-1])
        rows[inside] = features
        vectors = self.p["embedding"][rows[:, 0]]
        for c in range(1, features.shape[1]):
            vectors += self.p["embedding"][rows[:, c]]
        size = len(rows) - pad
        open_ = np.zeros(size, bool)
        open_[inside] = True
        open_[starts[n == 0]] = True
        pooled, places = [], []
        for w in WIDTHS:
            values = np.tile(self.p[f"bias{w}"], (size, 1))
            for j in range(w):
                values += vectors[j : j + size] @ self.p[f"filter{w}"][j]
            values[~open_] = -np.inf
            top = np.maximum.reduceat(values, starts, axis=0)
            pooled.append(top)
            if with_places:
                ends = np.append(starts[1:], size)
                places.append(np.stack([a + values[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        pooled = np.concatenate(pooled, 1)
        logits = np.maximum(pooled, 0) @ self.p["out"] + self.p["shift"][0]
        return (logits, pooled, places, rows, vectors) if with_places else logits

    def gradients(self, features, offsets, labels, total: int) -> tuple[dict, np.ndarray, np.ndarray]:
        """The share of these texts in the gradient of a batch of ``total``: dense parts, embeddings met, their sums."""
        logits, pooled, places, rows, vectors = self.forward(features, offsets, True)
        error = ((1 / (1 + np.exp(-logits)) - labels) / total).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items() if k != "embedding"}
        touched, moves = [], []
        grads["out"] = error @ np.maximum(pooled, 0)
        grads["shift"][0] = error.sum()
        back = error[:, None] * self.p["out"] * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"bias{w}"] = part.sum(0)
            for j in range(w):
                at = places[i] + j
                grads[f"filter{w}"][j] = np.einsum("df,dfk->kf", part, vectors[at])
                to = part[:, :, None] * self.p[f"filter{w}"][j].T[None]
                for c in range(rows.shape[1]):
                    touched.append(rows[at, c].ravel())
                    moves.append(to.reshape(-1, DIM))
        numbers, sums = _summed(touched, moves)
        sums[numbers == 0] = 0
        return grads, numbers, sums

    def batch_gradients(self, samples: list[np.ndarray], labels: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """The gradient of a batch, from parts of about ``PART`` words, one text at least: memory does not follow the batch's longest texts."""
        sizes = np.array([len(x) for x in samples])
        part = np.cumsum(sizes) // PART
        grads, touched, moves = {}, [], []
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            offsets = np.concatenate([[0], np.cumsum(sizes[at])])
            own, numbers, sums = self.gradients(np.concatenate([samples[i] for i in at]), offsets, labels[at], len(labels))
            grads = {name: g + grads[name] if grads else g for name, g in own.items()}
            touched.append(numbers)
            moves.append(sums)
        return grads, *(_summed(touched, moves) if len(touched) > 1 else (touched[0], moves[0]))

    def state(self) -> bytes:
        """The model as plain arrays, to send and to keep."""
        return pickle.dumps((self.p, self.thresholds))

    @classmethod
    def of(cls, state: bytes) -> Network:
        net = cls.__new__(cls)
        net.p, net.thresholds = pickle.loads(state)
        return net

    def scores(self, features, offsets, languages) -> np.ndarray:
        if not len(languages):
            return np.zeros(0)
        logits = self.forward(features, offsets) - self.thresholds[languages]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30).astype(float)))


def _summed(numbers: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers with the sums of their rows of values."""
    numbers, place = np.unique(np.concatenate(numbers), return_inverse=True)
    sums = np.zeros((len(numbers), DIM), np.float32)
    np.add.at(sums, place, np.concatenate(values))
    return numbers, sums


class Learner:
    """A network on its way through one shard, and what an epoch moved."""

    def __init__(self, state: bytes):
        net, self.m, self.v, self.moved, self.step = pickle.loads(state)
        self.net = Network.of(net)
        self.first = {k: x.copy() for k, x in self.net.p.items()}
        self.moved_first, self.met, self.rows = self.moved.copy(), np.zeros(TABLE, bool), 0

    @staticmethod
    def state(net: Network, m: dict, v: dict, moved: np.ndarray, step: float) -> bytes:
        return pickle.dumps((net.state(), m, v, moved, step))

    def learn(self, samples: list[np.ndarray], labels: np.ndarray, r: np.random.Generator) -> None:
        """One pass over a block, in a random order."""
        order, net = r.permutation(len(labels)), self.net
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            grads, numbers, sums = net.batch_gradients([samples[i] for i in batch], labels[batch])
            self.moved[numbers] += (sums**2).sum(1)
            net.p["embedding"][numbers] -= RATE * sums / np.sqrt(self.moved[numbers])[:, None]
            self.met[numbers] = True
            self.step += 1
            for k, g in grads.items():
                self.m[k] += 0.1 * (g - self.m[k])
                self.v[k] += 0.001 * (g * g - self.v[k])
                net.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-7)
        self.rows += len(labels)

    def moves(self) -> Iterator[pa.RecordBatch]:
        """What moved, as whole numbers of ``UNIT``, to be weighted by the rows."""
        at = np.flatnonzero(self.met)
        change = np.column_stack([self.net.p["embedding"][at] - self.first["embedding"][at], self.moved[at] - self.moved_first[at]])
        yield from _sent(at, _whole(change), self.rows)
        dense = np.column_stack([_flat(x) for x in ({k: self.net.p[k] - self.first[k] for k in self.m}, self.m, {k: np.sqrt(x) for k, x in self.v.items()})])
        dense = np.vstack([dense, np.full((1, 3), self.step / STEPS)])
        yield _row(-1, np.arange(len(dense)), _whole(dense), self.rows)


def _flat(parts: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in parts.values()])


def _whole(values: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(values.astype(float), -127, 127) * UNIT).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """The numbers column by column, their bytes by place, compressed."""
    return pa.compress(np.ascontiguousarray(x.T).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, rows: int, columns: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    body = pa.decompress(data, decompressed_size=rows * columns * size, codec="zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind)
    return np.ascontiguousarray(flat.reshape(columns, rows).T)


_SUM = "slice int, n int, width int, weight long, numbers binary, amounts binary"


def _row(part: int, numbers: np.ndarray, values: np.ndarray, weight: int) -> pa.RecordBatch:
    cells = (part, len(numbers), values.shape[1], weight, numbers.astype(np.int32).tobytes(), _packed(values))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in _SUM.split(", ")])


def _sent(numbers: np.ndarray, values: np.ndarray, weight: int) -> Iterator[pa.RecordBatch]:
    """Sorted numbers of features and their whole values, by ranges of the numbers."""
    edges = np.searchsorted(numbers, np.arange(SLICES + 1) * (TABLE // SLICES))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[part], edges[part + 1])
        yield _row(part, numbers[at], values[at], weight)


def _received(row: dict, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["numbers"], np.int32), _unpacked(row["amounts"], kind, row["n"], row["width"])


def _adder(limit: int, mean: bool):
    """The weighted sums or means of a slice, a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = weight = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part = row["slice"]
                base = max(part, 0) * (TABLE // SLICES)
                numbers, values = _received(row, np.int32)
                if total is None:
                    size = limit if part < 0 else TABLE // SLICES
                    total, weight = np.zeros((size, values.shape[1]), np.int64), np.zeros(size, np.int64)
                total[numbers - base] += values * np.int64(row["weight"])
                weight[numbers - base] += row["weight"]
        if total is not None:
            at = np.flatnonzero(weight)
            out = (total[at] / (weight[at, None] * UNIT)).astype(np.float32) if mean else total[at]
            yield _row(part, at + base, out, int(weight.sum()))

    return run


def _added(sent: DataFrame, limit: int = 0, mean: bool = True) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """(numbers, means or sums) of the features, and under True those of the dense parts; of fixed size."""
    got: dict[bool, list] = {}
    for row in sent.groupBy("slice").applyInArrow(_adder(limit, mean), _SUM).collect():
        got.setdefault(row.slice < 0, []).append((row.slice, *_received(row.asDict(), np.float32 if mean else np.int64)))
    out = {}
    for kind, parts in got.items():
        parts.sort(key=lambda x: x[0])
        out[kind] = np.concatenate([n for _, n, _ in parts]), np.concatenate([v for _, _, v in parts])
    return out


_BLOCK = "shard int, kept boolean, n int, toxic int, sizes binary, labels binary, languages binary, distinct int, vocabulary binary, words binary"


def _coded(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the distinct words, the most frequent first, and the place there of every word)."""
    key = (features.astype(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, features.shape[1] + 1, dtype=np.uint64))).sum(1)
    _, first, place, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return features[first[order]], rank[place]


def _encode(batches):
    """Blocks of encoded texts; a block is of one shard, and all of it is kept for the thresholds or none."""
    give_back()
    features, width = Features(), 1 + len(PREFIXES)
    types = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 2)
    for batch in pieces(batches, "text", BLOCK):
        numbers, offsets, languages = features(batch.column("text"))
        samples = [numbers[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        shard, kept, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kept", "label"))
        for s, k in sorted(set(zip(shard.tolist(), kept.tolist(), strict=True))):
            at = np.flatnonzero((shard == s) & (kept == k))
            sizes, labels = np.array([len(samples[i]) for i in at], np.int32), label[at].astype(np.int8)
            vocabulary, words = _coded(np.concatenate([samples[i] for i in at]).reshape(-1, width))
            cells = (s, k, len(at), int(labels.sum()), sizes.tobytes(), labels.tobytes(), languages[at].tobytes(), len(vocabulary), _packed(vocabulary), _packed(words[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])
    give_back()


def _blocks(batches):
    """(shard, features, offsets, labels, languages) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            sizes = np.frombuffer(row["sizes"], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            vocabulary = _unpacked(row["vocabulary"], np.int32, row["distinct"], 1 + len(PREFIXES))
            words = _unpacked(row["words"], np.int32, int(offsets[-1]), 1)[:, 0]
            yield row["shard"], vocabulary[words], offsets, np.frombuffer(row["labels"], np.int8).astype(np.int64), np.frombuffer(row["languages"], np.int32)


def _presence(batches):
    """In how many clean and toxic texts a feature occurs."""
    seen = np.zeros((TABLE, 2), np.int32)
    for _, features, offsets, labels, _ in _blocks(batches):
        for a, b, y in zip(offsets, offsets[1:], labels, strict=False):
            seen[np.unique(features[a:b]), y] += 1
    at = np.flatnonzero(seen.any(1))
    yield from _sent(at, seen[at], 1)


def _epoch(state, epoch: int, seed: int):
    def run(batches):
        give_back()
        own = shard = None
        for part, (s, features, offsets, labels, _) in enumerate(_blocks(batches)):
            if s != shard:
                if own is not None:
                    yield from own.moves()
                own, shard, start = Learner(state.value), s, part
            own.learn([features[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], labels, np.random.default_rng((seed, epoch, s, part - start)))
        if own is not None:
            yield from own.moves()
        own = None
        give_back()

    return run


def _logits(state):
    def run(batches):
        net = Network.of(state.value)
        for _, features, offsets, labels, languages in _blocks(batches):
            logits = net.forward(features, offsets).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(languages), pa.array(logits), pa.array(labels)], names=["language", "logit", "label"])

    return run


def _started(fit_blocks: DataFrame, clean: int, toxic: int, seed: int) -> Network:
    """Log odds of a feature's presence start one embedding dimension, which one filter of each width reads."""
    net, seen = Network(seed), np.zeros((TABLE, 2))
    for numbers, sums in _added(fit_blocks.mapInArrow(_presence, _SUM), mean=False).values():
        seen[numbers] = sums
    share = (seen + 0.5) / (np.array([clean, toxic]) + 1)
    odds = np.clip(np.log(share[:, 1] / share[:, 0]), -1, 6)
    odds[seen.sum(1) < 3] = 0
    net.p["embedding"][:, 0] = np.where(odds > 1, odds, 0) / 3
    net.p["embedding"][0] = 0
    for w in WIDTHS:
        net.p[f"filter{w}"][:, 0, 0] = 1.0 / w
    return net


def train(fit_blocks: DataFrame, clean: int, toxic: int, seed: int = 11) -> Network:
    """A network without thresholds from all blocks, which hold so many clean and toxic rows."""
    context = fit_blocks.sparkSession.sparkContext
    net = _started(fit_blocks, clean, toxic, seed)
    dense = [k for k in net.p if k != "embedding"]
    m, v = ({k: np.zeros_like(net.p[k]) for k in dense} for _ in range(2))
    moved, step = np.full(TABLE, 1e-4, np.float32), 0.0
    size = sum(net.p[k].size for k in dense) + 1
    for epoch in range(EPOCHS):
        state = context.broadcast(Learner.state(net, m, v, moved, step))
        got = _added(fit_blocks.mapInArrow(_epoch(state, epoch, seed), _SUM), size)
        state.destroy()
        if False in got:
            numbers, mean = got[False]
            net.p["embedding"][numbers] += mean[:, :DIM]
            moved[numbers] += mean[:, DIM]
        (_, mean), at = got[True], 0
        for k in dense:
            part = mean[at : at + net.p[k].size].reshape(*net.p[k].shape, 3)
            net.p[k] += part[..., 0]
            m[k], v[k] = part[..., 1].copy(), part[..., 2] ** 2
            at += net.p[k].size
        step = float(mean[-1, 0] * STEPS)
    return net


def thresholds(logits: DataFrame) -> np.ndarray:
    """For each language the middle of the widest gap among the cuts with the fewest errors, from (language, logit, label).

    A language with fewer than five rows of a class takes the cut of all. Cuts lie between different logits, so equal ones fall on one side.
    """
    counted = logits.groupBy("language", "logit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    both = F.explode(F.array(F.lit(-1), F.col("language").cast("int"))).alias("g")
    points = counted.select(both, F.col("logit").alias("x"), "t", "c").groupBy("g", "x").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    points = Stage(logits.sparkSession, "toxicity").write(points, "points")
    # Running counts by ranges of logits: no task orders a whole language.
    edges = sorted(set(points.where("g = -1").approxQuantile("x", [i / 64 for i in range(1, 64)], 0.002)))
    points = points.withColumn("bin", F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col("x"))))
    bins = points.groupBy("g", "bin").agg(F.sum("t").alias("bin_t"), F.sum("c").alias("bin_c"), F.min("x").alias("low"))
    before, whole = Window.partitionBy("g").orderBy("bin"), Window.partitionBy("g")
    bins = bins.select(
        "g", "bin", F.lead("low").over(before).alias("above"), (F.sum("bin_t").over(before) - F.col("bin_t")).alias("t0"), (F.sum("bin_c").over(before) - F.col("bin_c")).alias("c0"),
        F.sum("bin_t").over(whole).alias("all_t"), F.sum("bin_c").over(whole).alias("all_c"), F.min("low").over(whole).alias("lowest"),
    )
    inside = Window.partitionBy("g", "bin").orderBy("x")
    cuts = points.join(F.broadcast(bins), ["g", "bin"]).select(
        "g", "all_t", "all_c", "x", "lowest",
        F.coalesce(F.lead("x").over(inside), "above", F.col("x") + 1).alias("next"),
        (F.col("t0") + F.sum("t").over(inside) + F.col("all_c") - F.col("c0") - F.sum("c").over(inside)).alias("errors"),
    )
    # The cut below all rows beside those above a row.
    below = F.struct(F.col("all_c").alias("errors"), F.lit(-1.0).alias("gap"), (F.col("lowest") - 0.5).alias("at"))
    above = F.struct("errors", (F.col("x") - F.col("next")).alias("gap"), ((F.col("x") + F.col("next")) / 2).alias("at"))
    best = cuts.groupBy("g", "all_t", "all_c").agg(F.least(F.min(above), F.min(below)).alias("best"))
    found = {r.g: r for r in best.collect()}
    out = np.zeros(len(LANGUAGES), np.float32)
    for g in range(len(LANGUAGES)):
        own = found.get(g)
        own = found.get(-1) if own is None or min(own.all_t, own.all_c) < 5 else own
        out[g] = own.best["at"] if own else 0.0
    return out


def _maybe(known: DataFrame, n: int):
    """A test of ids that all of ``known`` pass and few others: the rows it keeps out need not travel to be joined.

    One bit each in a field of 16 bits an id, 8 MB at most, beyond which more of the others pass.
    """
    bits = 1 << min(26, max(12, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("_id"), F.lit(bits))
    marks = known.select(place.alias("place")).selectExpr("place DIV 64 AS at", "shiftleft(1L, CAST(place % 64 AS int)) AS mark")
    marks = marks.groupBy("at").agg(F.bit_or("mark").alias("mark")).toArrow()
    field = np.zeros(bits // 64, np.int64)
    field[marks["at"].to_numpy()] = marks["mark"].to_numpy()
    sent = known.sparkSession.sparkContext.broadcast(field.view(np.uint64))

    @F.pandas_udf("boolean")
    def passes(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda key: passes(F.pmod(F.xxhash64(key), F.lit(bits)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> bytes | None:
    """The classifier's state from all labelled rows outside the held-out fold; None if a class is missing.

    There is one row for each labelled id: of rows that share an id, the greatest text. A fifth, by hash, is kept for the thresholds.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id"), "label")
    n = known.count()
    shards = max(1, -(-n // SHARD))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # The one shuffle of the texts deals them to their shards.
    texts = texts.where(F.col("doc_id").isNotNull() & _maybe(known, n)("doc_id")).select(F.col("doc_id").alias("_id"), "text", F.lit(None).cast("int").alias("label"))
    met = texts.unionByName(known, allowMissingColumns=True).repartition(shards, "_id")
    rows = met.groupBy("_id").agg(F.max("label").alias("label"), F.max("text").alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    draw = F.xxhash64(F.lit(seed), "_id")
    dealt = rows.select("text", "label", F.pmod(F.hash("_id"), F.lit(shards)).alias("shard"), (F.pmod(draw, F.lit(5)) == 4).alias("kept"), draw.alias("draw"))
    dealt = dealt.sortWithinPartitions("shard", "draw").drop("draw")
    blocks = Stage(spark, "toxicity").write(dealt.mapInArrow(_encode, _BLOCK), "blocks")
    counts = {r.kept: r for r in blocks.groupBy("kept").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    n, toxic = (sum(r[c] for r in counts.values()) for c in ("n", "toxic"))
    if not 0 < toxic < n or False not in counts:
        return None
    net = train(blocks.where("NOT kept"), counts[False].n - counts[False].toxic, counts[False].toxic, seed)
    state = spark.sparkContext.broadcast(net.state())
    net.thresholds = thresholds(blocks.where("kept").mapInArrow(_logits(state), "language int, logit double, label long"))
    return net.state()


def _scored(spark: SparkSession, docs: DataFrame, state: bytes | None, text: str, with_text: bool) -> DataFrame:
    """``_row`` (all columns but the text), ``text`` if wanted, and ``score`` of every row; columns of any name stay apart."""
    model = spark.sparkContext.broadcast(state)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*rest).alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([packed.schema["_row"], *([packed.schema["text"]] if with_text else []), StructField("score", DoubleType())])

    def run(batches):
        give_back()  # what training may have left in this worker
        features = Features()
        net = None if model.value is None else Network.of(model.value)
        for batch in pieces(batches, "text", 1 << 19):
            score = np.zeros(batch.num_rows) if net is None else net.scores(*features(batch.column("text")))
            names = ["_row", "text"] if with_text else ["_row"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(score)], names=[*names, "score"])
        give_back()

    return packed.mapInArrow(run, schema)


def predictions(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = _scored(spark, docs.select("doc_id", "text"), fit(docs, labels), "text", with_text=False)
    key = F.col("_row.doc_id")
    return out.select(key.alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents found toxic, all columns kept, whatever their names."""
    clean = _scored(spark, docs, fit(docs, labels, text=text), text, with_text=True).where("score < 0.5")
    return clean.select(*[(F.col("text") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
