"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of good quality; everything else that is learned from is unlabelled web
text, and no negative label is used. The class prior is estimated first, from below (``class_prior``). Then a
small network minimises
prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)), and turns its gradient around where the second part falls
below zero. Its sigmoid is the score.

The features of a text are shares and counts over its bytes, words and lines; no other column is an input.
The fit takes a bounded sample: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` texts, those with the
smallest hash, all outside the held-out fold. Every text is scored whole, where it is read, without a shuffle.

Null and empty texts are scored as texts without words. Null labels are skipped; a document labelled twice is
a positive if every label says so. Repeated rows get equal scores. Without positives every score is 0. Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.toxicity import held_out
from contestry.llm.words import Words, pieces, text_bytes

MAX_POSITIVE, MAX_UNLABELLED = 8000, 20000
HIDDEN, EPOCHS, BATCH, RATE = 16, 30, 256, 0.01
THRESHOLD = 0.3
#: Kinds of bytes whose shares are features.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n",
    "stop": b".,;:?", "shout": b"!", "table": b"|", "sign": b"*#$%&@^~+=<>{}[]\\/_`", "quote": b"'\"()-",
}


def features(words: Words, texts: pa.Array) -> np.ndarray:
    """(texts, features): shares of byte kinds, repetition of words and bigrams, sizes."""
    data, offsets = text_bytes(texts)
    size = np.diff(offsets).astype(float)
    hashes, at = words(texts)
    n = np.diff(at)
    columns = []
    for kind in KINDS.values():
        table = np.zeros(256, np.uint8)
        table[list(kind)] = 1
        run = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        columns.append((run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(size, 1))
    high = np.concatenate([[0], np.cumsum(data >> 7, dtype=np.int64)])
    columns.append((high[offsets[1:]] - high[offsets[:-1]]) / np.maximum(size, 1))
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    first = np.minimum(at[:-1] + 1, at[1:])
    columns.append((same[at[1:]] - same[first]) / np.maximum(n, 1))
    distinct, top, pairs = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    both = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    for i in range(len(n)):
        a, b = at[i], at[i + 1]
        if b > a:
            part = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            distinct[i], top[i] = (len(edges) - 1) / (b - a), np.diff(edges).max() / (b - a)
            if b - a > 1:
                two = np.sort(both[a : b - 1])
                pairs[i] = (1 + (two[1:] != two[:-1]).sum()) / (b - a - 1)
    columns += [distinct, top, pairs, np.log1p(n), np.log1p(size), size / np.maximum(n, 1) / 10, distinct * np.log1p(n)]
    lines = columns[list(KINDS).index("line")] * size + 1
    columns.append(np.log1p(n / lines))
    return np.stack(columns, 1)


class Net:
    """One hidden layer; ``predict`` gives the logit."""

    def __init__(self, x: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        d = x.shape[1]
        self.p = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def state(self) -> list[np.ndarray]:
        return [self.mean, self.scale, *self.p]

    @classmethod
    def of(cls, state: list[np.ndarray]) -> Net:
        net = cls.__new__(cls)
        net.mean, net.scale, *net.p = state
        return net

    def _forward(self, x):
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0], h, z

    def gradient(self, x: np.ndarray, slope) -> list[np.ndarray]:
        """``slope``: the loss's derivative by the logit, divided by the number of rows."""
        f, h, z = self._forward(x)
        g = slope(f)
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def _sigmoid(f):
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _descend(net: Net, gradients, steps: int) -> None:
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for t in range(1, steps + 1):
        for i, g in enumerate(gradients()):
            g = g + 1e-4 * net.p[i]
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            net.p[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """A lower confidence bound of the share of positives in the unlabelled sample.

    Each half of both samples trains a positive-against-unlabelled classifier and the other half is ranked by it. Above any
    cut the share of unlabelled rows, divided by that of positives, is at least the prior; the cut with the least upper bound
    (95 %, whatever the distributions) is taken, and there the lower bound. The two halves' bounds are averaged. A prior that is
    too large lets the negative part of the risk vanish, so that all rows become positive; one that is too small costs little.
    """
    halves = [(positive[i::2], unlabelled[i::2]) for i in (0, 1)]
    return float(np.clip(np.mean([_prior_bound(*halves[i], *halves[1 - i], seed) for i in (0, 1)]), 0.05, 0.99))


def _prior_bound(positive, unlabelled, other_positive, other_unlabelled, seed: int) -> float:
    r = np.random.default_rng(seed)
    net = Net(np.concatenate([positive, unlabelled]), seed)

    def gradients():
        p, u = positive[r.integers(len(positive), size=BATCH)], unlabelled[r.integers(len(unlabelled), size=BATCH)]
        a = net.gradient(p, lambda f: (_sigmoid(f) - 1) / BATCH)
        b = net.gradient(u, lambda f: _sigmoid(f) / BATCH)
        return [x + y for x, y in zip(a, b, strict=True)]

    _descend(net, gradients, 1000)
    p, u = np.sort(net.logits(other_positive)), np.sort(net.logits(other_unlabelled))
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.9, 181)))
    above_p, above_u = (1 - np.searchsorted(z, cuts) / len(z) for z in (p, u))
    slack_p, slack_u = ((np.log(40) / 2 / len(z)) ** 0.5 for z in (p, u))
    best = int(np.argmin((above_u + slack_u) / np.maximum(above_p - slack_p, 1e-9)))
    return (above_u[best] - slack_u) / (above_p[best] + slack_p)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Net:
    """A network of least non-negative risk on the logistic loss."""
    r = np.random.default_rng(seed)
    net = Net(unlabelled, seed)

    def gradients():
        p, u = positive[r.integers(len(positive), size=BATCH)], unlabelled[r.integers(len(unlabelled), size=BATCH)]
        fp, fu = net.logits(p), net.logits(u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        minus = [
            a - b
            for a, b in zip(net.gradient(u, lambda f: _sigmoid(f) / BATCH), net.gradient(p, lambda f: prior * _sigmoid(f) / BATCH), strict=True)
        ]
        if negative < 0:
            return [-g for g in minus]
        plus = net.gradient(p, lambda f: prior * (_sigmoid(f) - 1) / BATCH)
        return [a + b for a, b in zip(plus, minus, strict=True)]

    _descend(net, gradients, EPOCHS * max(100, len(unlabelled) // BATCH))
    return net


def _featurize(batches):
    words = Words()
    for batch in pieces(batches, "text"):
        x = features(words, batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), lists], names=["positive", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 5) -> tuple[Net, float] | None:
    """(network, estimated prior), or None without positives."""
    draw = F.xxhash64(F.lit(seed), "doc_id")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = known.groupBy("doc_id").agg(F.min(label).alias("y")).where("y = 1").orderBy(draw, "doc_id").limit(MAX_POSITIVE)
    trusted = trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("positive"))
    web = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    web = web.limit(MAX_UNLABELLED).select(F.col("doc_id").alias("_id"), F.lit(False).alias("positive"))
    # Both lists are bounded samples.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(trusted.union(web)), F.col("doc_id") == F.col("_id"))
    rows = sample.select("text", "positive").mapInArrow(_featurize, "positive boolean, x array<double>").toArrow()
    is_positive = rows["positive"].to_numpy()
    if not is_positive.any():
        return None
    x = np.asarray(rows["x"].combine_chunks().values).reshape(len(is_positive), -1)
    order = np.lexsort([*x.T, is_positive])  # whatever order the rows arrive in
    order = np.random.default_rng(seed).permutation(order)
    x, is_positive = x[order], is_positive[order]
    positive, unlabelled = x[is_positive], x[~is_positive]
    prior = class_prior(positive, unlabelled, seed) if len(positive) > 1 and len(unlabelled) > 1 else 0.5
    return train(positive, unlabelled, prior, seed), prior


def predictions(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, class_prior."""
    docs = docs.select("doc_id", "text")
    found = fit(docs, labels)
    # Plain arrays, so workers need no copy of the package to read them.
    model = spark.sparkContext.broadcast(found[0].state() if found else None)

    def run(batches):
        words = Words()
        net = None if model.value is None else Net.of(model.value)
        for batch in pieces(batches, "text"):
            score = np.zeros(batch.num_rows) if net is None else _sigmoid(net.logits(features(words, batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.lit(found[1] if found else None).cast("double").alias("class_prior"),
    )
