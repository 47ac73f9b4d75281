"""Tokens of two vocabularies side by side: groups of tokens that cover the same bytes, and how often ids meet.

A byte-level vocabulary (A, a rank file) and a piece vocabulary (B, a sentencepiece model, which puts a space
before a text) both encode the text with a space before it. Byte offsets where an A and a B token both end cut
the tokens into groups. Groups are found by pointer jumping: every token points to its farthest-right
overlapping token, the last token of a group to itself, and ``next = next[next]`` until nothing changes leaves
every token at its group's last one (``groups``), for all texts of a batch at once.

A link is a pair of token occurrences whose bytes overlap; the count of an id pair is the number of its links in
the whole corpus. Texts are encoded once, into blocks of some ``BLOCK`` bytes that lie in a table bucketed by
block, with each block's distinct pairs and their numbers. Those alone are summed by pair; the sums go back to
the blocks that hold the pair, where each document's links look them up. The best count of every B id is at
most one row an id of the vocabulary, so it is broadcast.

A text that is null or empty, or whose B bytes are not the text with its space (a normalised or unknown character),
has no tokens: zeros and an empty string. Special tokens' strings are ordinary text. Long texts are cut where both
vocabularies allow it, so memory is bounded by a block, or one long text's ids. Repeated rows count each; a null
doc_id stays null; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.bpe import Ranks
from contestry.llm.words import pieces
from contestry.session import Stage

BLOCK, BATCH = 8 << 20, 1 << 20
CHUNK = 1 << 16
TOKEN_GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>"
BLOCKS = "block long, doc_id array<long>, a_sizes array<int>, b_sizes array<int>, a_ids binary, b_ids binary, pairs array<long>, n array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Pieces:
    """Ids of the sentencepiece model at ``path``, and the bytes of each id."""

    def __init__(self, path: str, chunk: int = CHUNK):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        # No piece goes on over a space, so none covers the end of a word and the space after it.
        self.chunk = chunk if not any("▁" in s.lstrip("▁") for s in names) else None
        self.safe = re.compile("[A-Za-z0-9](?= [A-Za-z0-9])")

    def encode(self, text: str) -> list[int]:
        if self.chunk is None or len(text) <= self.chunk:
            return self.model.encode(text, num_threads=1)
        ids, at = [], 0
        while at < len(text):
            cut = self.safe.search(text, at + self.chunk)
            stop = cut.end() if cut else len(text)
            ids += self.model.encode(text[at:stop], num_threads=1)
            at = stop + 1  # the model puts the space back
        return ids


class Pair:
    """Both vocabularies; encodes texts and tells the sizes of tokens."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str, chunk: int = CHUNK):
        self.a, self.b = Ranks(ranks_path, pattern, chunk), Pieces(model_path, chunk)
        self.a_bytes = np.array([len(x) for x in self.a.token_bytes()], np.int64)
        self.b_bytes = np.array([len(x) for x in self.b.bytes], np.int64)
        self.a_type, self.b_type = ("<u2" if len(x) <= 1 << 16 else "<u4" for x in (self.a_bytes, self.b_bytes))
        digits = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        ids = np.arange(max(len(self.a_bytes), len(self.b_bytes)))
        powers = 10 ** np.arange(digits)[::-1]
        self.decimal = np.concatenate([48 + ids[:, None] // powers % 10, np.zeros((len(ids), 1))], 1).astype(np.uint8)
        self.shown = np.concatenate([(ids[:, None] >= powers) | (powers == 1), np.ones((len(ids), 1), bool)], 1)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        b = self.b.encode(text) if text else []
        spaced = " " + (text or "")
        if not b or b"".join(map(self.b.bytes.__getitem__, b)) != spaced.encode():
            return np.zeros(0, self.a_type), np.zeros(0, self.b_type)
        return self.a.encode(spaced).astype(self.a_type), np.array(b, self.b_type)

    def encode_all(self, texts: list[str | None]) -> Tokens:
        both = [self.encode(t) for t in texts]
        sizes = [np.array([len(x[k]) for x in both], np.int64) for k in (0, 1)]
        ids = [np.concatenate([x[k] for x in both]) for k in (0, 1)]
        return Tokens(self, *ids, *sizes)


class Tokens:
    """The tokens of several texts, one text behind the other."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.pair, self.a, self.b, self.a_sizes, self.b_sizes = pair, a, b, a_sizes, b_sizes
        a_end, b_end = np.cumsum(pair.a_bytes[a]), np.cumsum(pair.b_bytes[b])
        self.over_a = np.searchsorted(b_end, a_end)  # the B token that holds an A token's last byte
        self.over_b = np.searchsorted(a_end, b_end)
        self.last = a_end[self.over_b] == b_end  # B tokens that end a group

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each A and of each B token, numbered through all texts."""
        n = len(self.a)
        to = np.concatenate([n + self.over_a, np.where(self.last, n + np.arange(len(self.b)), self.over_b)])
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        label = (np.cumsum(self.last) - 1)[to - n]
        return label[:n], label[n:]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pair, text) of each link. A link's bytes end where one of its tokens ends, so every end of a token is one link's."""
        more = np.flatnonzero(~self.last)
        a = np.concatenate([self.a, self.a[self.over_b[more]]]).astype(np.int64)
        b = np.concatenate([self.b[self.over_a], self.b[more]])
        texts = np.arange(len(self.a_sizes))
        return a << 32 | b, np.concatenate([np.repeat(texts, self.a_sizes), np.repeat(texts, self.b_sizes)[more]])

    def texts(self, a_group: np.ndarray, b_group: np.ndarray) -> pa.Array:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, ids in decimals."""
        n, m = len(self.a), len(self.b)
        count = int(b_group[-1]) + 1 if m else 0
        numbers = np.arange(count)
        at = np.empty(n + m, np.int64)  # where a token stands: a group's A tokens, then its B tokens
        a_at = np.arange(n) + np.searchsorted(b_group, numbers)[a_group]
        b_at = np.arange(m) + np.searchsorted(a_group, numbers, "right")[b_group]
        at[a_at], at[b_at] = self.a, self.b
        mark = np.full(n + m, ord(","), np.uint8)
        mark[a_at[np.flatnonzero(np.diff(a_group, append=-1))]] = ord("|")
        mark[b_at[np.flatnonzero(np.diff(b_group, append=-1))]] = ord(";")
        shown = self.pair.shown[at]
        ends = np.cumsum(self.a_sizes + self.b_sizes)
        full = ends[(self.a_sizes + self.b_sizes) > 0]
        shown[full - 1, -1] = False
        rows = self.pair.decimal[at]
        rows[:, -1] = mark
        sizes = np.concatenate([[0], np.cumsum(shown.sum(1))])[np.concatenate([[0], ends])]
        buffers = [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(rows[shown].tobytes())]
        return pa.LargeStringArray.from_buffers(len(ends), buffers[1], buffers[2]).cast(pa.string())


def _lists(values: np.ndarray, sizes: np.ndarray, kind=pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _grouper(vocabularies):
    def run(batches):
        pair = Pair(*vocabularies)
        for batch in pieces(batches, "text", BATCH):
            t = pair.encode_all(batch.column("text").to_pylist())
            a_group, b_group = t.groups()
            first = np.concatenate([[-1], b_group])[np.cumsum(t.b_sizes) - t.b_sizes] + 1
            own = [a_group - np.repeat(first, t.a_sizes), b_group - np.repeat(first, t.b_sizes)]
            columns = [_lists(t.a, t.a_sizes), _lists(t.b, t.b_sizes), _lists(own[0], t.a_sizes), _lists(own[1], t.b_sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])

    return run


def _blocker(vocabularies):
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches):
        pair = Pair(*vocabularies)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block():
            sizes = [np.concatenate([getattr(t, c) for _, t, _ in held]) for c in ("a_sizes", "b_sizes")]
            ids = [np.concatenate([getattr(t, c) for _, t, _ in held]).tobytes() for c in ("a", "b")]
            pairs, where = np.unique(np.concatenate([p[0] for _, _, p in held]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for _, _, p in held]), minlength=len(pairs)).astype(np.int64)
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((sum((d for d, _, _ in held), []), pa.int64()), (sizes[0], pa.int32()), (sizes[1], pa.int32()))]
            tail = [pa.array([x], pa.binary()) for x in ids] + [pa.array([x], pa.list_(pa.int64())) for x in (pairs, n)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *tail], names=names)

        for batch in pieces(batches, "text", BATCH):
            t = pair.encode_all(batch.column("text").to_pylist())
            held.append((batch.column("doc_id").to_pylist(), t, np.unique(t.links()[0], return_counts=True)))
            t.over_a = t.over_b = t.last = None
            size += batch.column("text").nbytes
            if size >= BLOCK:
                yield block()
                held, size, number = [], 0, number + 1
        if held:
            yield block()

    return run


def _finisher(vocabularies):
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    made = []  # the vocabularies, read once a worker

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        if not made:
            made.append(Pair(*vocabularies))
        pair = made[0]
        block = row.to_pydict()
        sizes = [np.array(block[c][0], np.int64) for c in ("a_sizes", "b_sizes")]
        ids = [np.frombuffer(block[c][0], t) for c, t in (("a_ids", pair.a_type), ("b_ids", pair.b_type))]
        asked = answers.column("pair").to_numpy()
        order = np.argsort(asked)
        asked, count, best = asked[order], answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order]
        out = []
        stops = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
        parts = np.flatnonzero(np.diff((stops[0] + stops[1]) // BATCH, prepend=-1))[1:].tolist()
        edges = sorted({0, *parts, len(sizes[0])})
        for i, j in zip(edges, edges[1:], strict=False):
            (a, b), (na, nb) = (x[s[i] : s[j]] for x, s in zip(ids, stops, strict=True)), (s[i:j] for s in sizes)
            t = Tokens(pair, a, b, na, nb)
            a_group, b_group = t.groups()
            pairs, of = t.links()
            at = np.searchsorted(asked, pairs)
            if len(pairs) and not np.array_equal(asked[np.minimum(at, len(asked) - 1)], pairs):
                raise RuntimeError("a pair of a block has no count")
            sums = [np.zeros(j - i, np.int64) for _ in range(2)]
            np.add.at(sums[0], of, best[at].astype(np.int64))
            np.add.at(sums[1], of, count[at])
            groups = np.diff(np.concatenate([[0], b_group + 1])[np.cumsum(nb)], prepend=0)
            columns = [pa.array(block["doc_id"][0][i:j], pa.int64()), *map(pa.array, (na, nb, groups, np.bincount(of, minlength=j - i), *sums)), t.texts(a_group, b_group)]
            out.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(out)

    return run


def token_groups(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, its ids in both vocabularies, and the number of each token's group in the document."""
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(_grouper((ranks_path, pattern, model_path)), TOKEN_GROUPS)


def alignment(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``n_best`` counts the links whose pair has the highest count of all pairs of its B id, ties included;
    ``count_sum`` sums the counts of the pairs of all links; ``groups`` is ``a1,a2|b1;a3|b2,b3``.
    """
    vocabularies = (ranks_path, pattern, model_path)
    stage = Stage(spark, "align")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"align_blocks_{uuid.uuid4().hex}"
    made = texts.mapInArrow(_blocker(vocabularies), BLOCKS)
    made.write.option("path", f"{stage.root}/blocks").option("compression", "zstd").bucketBy(parts, "block").format("parquet").saveAsTable(name)
    try:
        blocks = spark.table(name)
        asked = blocks.select(F.col("block").alias("asks"), F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("asks", "x.*").withColumnRenamed("pairs", "pair")
        counts = stage.write(asked.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
        b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
        best = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))  # at most one row an id of the vocabulary
        counts = counts.join(F.broadcast(best), b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
        answers = asked.select("asks", "pair").join(counts.hint("merge"), "pair")
        out = blocks.select("block", "doc_id", "a_sizes", "b_sizes", "a_ids", "b_ids").groupBy("block").cogroup(answers.groupBy("asks"))
        return out.applyInArrow(_finisher(vocabularies), ALIGNED)
    finally:  # the files stay, only their name goes
        spark.sql(f"DROP TABLE IF EXISTS {name}")
