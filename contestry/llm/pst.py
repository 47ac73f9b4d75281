"""Language-model scoring with a probabilistic suffix tree over words.

A context is the last one or two words of the text, or up to ``depth``. A state is kept for a context that training
text holds at least ``MIN_COUNT`` times at every size, whose shorter suffix is kept, and whose next words diverge from those of that suffix:
the mean log ratio of its own to its suffix's prediction, each occurrence left out of its own count, is at
least ``DIVERGENCE``. A state predicts with its counts smoothed towards its suffix,
(count + STRENGTH * p(suffix)) / (context count + STRENGTH); the root discounts every known word's count by a
constant and gives what that frees to the unknown word. A token is scored by the longest kept suffix before it.

How the work is spread. Texts are cut into blocks of bounded size where they are read; a block is one row of a
bucketed table and never moves again. What a block must know of the whole corpus it asks for: it sends its
distinct keys (words, n-grams or contexts) with its own counts to buckets of the key hash, as arrays; a bucket
sums equal keys and answers every block in the order asked. Answers lie in a table bucketed like the blocks, so
earlier ones are read where they are. Spark is asked to remove shuffle files with their query; the disk measured
has not shown it. Each key leaves a block once, however often the
block holds it, so a frequent word is no hot key; nothing is collected or broadcast but four totals. Level by
level the blocks ask for word counts, bigram counts, divergences of one-word contexts and trigram counts,
divergences of two-word contexts, and then score. All of it follows the size of the corpus. Keys go as differences
of the sorted hashes; they, their counts and the answers are compressed with the equal bytes of all numbers side by side.

Keys are 64-bit hashes. Null and empty texts are the end token alone. Rows repeated with one doc_id are
documents of their own. A null doc_id falls to the remainder of an empty text. If nothing is left to train on,
all scores are 0. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.words import Words, mix, pieces
from contestry.session import Stage

DEPTH, MIN_COUNT, DIVERGENCE, STRENGTH = 2, 32, 0.02, 100.0
#: Text in a block, in bytes.
BLOCK = 16 << 20
FOLDS, HELD = 7, 2
#: Spark's setting that removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = np.uint64(0)
_U = np.uint64

_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("train", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("vocabulary", pa.binary())])
BLOCKS = "block long, doc_id array<long>, size array<int>, train array<boolean>, tokens binary, vocabulary binary"
#: ``kind`` 2 d asks for the counts of (d + 1)-grams, 2 d + 1 for the divergence of d-word contexts.
_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("amounts", pa.binary())])
ASK = "kind int, bucket int, block long, keys binary, amounts binary"
_ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("sums", pa.binary()), ("first", pa.binary()), ("total", pa.int64()), ("known", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])
ANSWER = "kind int, bucket int, block long, sums binary, first binary, total long, known long, once long, twice long"
_SCORE = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _packed(x: np.ndarray) -> bytes:
    """The type's name, the length, and the numbers' bytes by place, compressed."""
    body = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode() + len(x).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:3].decode()), int.from_bytes(data[3:11], "little")
    body = pa.decompress(data[11:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _cut(batches):
    """Blocks of tokenised documents; a word is its place in the block's sorted vocabulary."""
    words, made = Words(), TaskContext.get().partitionId() << 32
    for batch in pieces(batches, "text", BLOCK):
        hashes, offsets = words(batch.column("text"))
        size = np.diff(offsets) + 1
        ends = np.cumsum(size)
        keys = np.zeros(ends[-1], _U)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        keys[inside] = np.maximum(hashes, _U(1))
        keys[~inside] = END
        vocabulary, tokens = np.unique(keys, return_inverse=True)
        row = (made, batch.column("doc_id").to_pylist(), size.astype(np.int32), batch.column("train").to_pylist(), tokens.astype(np.int32).tobytes(), vocabulary.tobytes())
        made += 1
        yield from _table([row], _BLOCK).to_batches()


def _asked(kind: int, block: int, keys: np.ndarray, amounts: np.ndarray, buckets: int) -> list[tuple]:
    """Rows that carry sorted keys and their amounts to the buckets of equal ranges of the hash."""
    to = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    edges = np.searchsorted(to, np.arange(buckets + 1))
    return [
        (kind, b, block, _packed(np.diff(keys[edges[b] : edges[b + 1]], prepend=_U(0))), _packed(amounts[edges[b] : edges[b + 1]]))
        for b in np.flatnonzero(np.diff(edges)).tolist()
    ]


def _summed(table: pa.Table) -> pa.Table:
    """One bucket: the sum of every key's amounts, answered to each block in the order it asked."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    counts = kind % 2 == 0
    keys = [np.cumsum(_unpacked(x), dtype=_U) for x in table["keys"].to_pylist()]
    amounts = np.concatenate([_unpacked(x) for x in table["amounts"].to_pylist()])
    unique, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.bincount(place, weights=amounts, minlength=len(unique))
    is_first = np.zeros(len(place), bool)
    is_first[first] = True
    rows, at = [], 0
    for block, own in zip(table["block"].to_pylist(), keys, strict=True):
        part = sums[place[at : at + len(own)]]
        if counts:
            part = part.astype(np.uint32 if sums.max() < 1 << 32 else np.uint64)
        rows.append((kind, bucket, block, _packed(part), np.packbits(is_first[at : at + len(own)]).tobytes(), None, None, None, None))
        at += len(own)
    if kind == 0:
        rows.append((kind, bucket, None, None, None, int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())))
    return _table(rows, _ANSWER)


class _Block:
    """A block's documents and the answers it has had so far, by kind."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        self.block = row["block"][0].as_py()
        self.doc_id = row["doc_id"][0].as_py()
        self.size = np.array(row["size"][0].as_py(), np.int64)
        self.train_doc = np.array(row["train"][0].as_py(), bool)
        self.tokens = np.frombuffer(row["tokens"][0].as_py(), np.int32).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"][0].as_py(), _U)
        self.train = np.repeat(self.train_doc, self.size)
        self.answers: dict[int, list] = {}
        for kind, bucket, sums, first in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "sums", "first")), strict=True):
            self.answers.setdefault(kind, []).append((bucket, sums, first))

    def answer(self, kind: int, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(sums, whether this block was the first to ask) for the keys in the order before they were sorted by ``order``."""
        sums, first = [], []
        for _, s, f in sorted(self.answers[kind]):
            part = _unpacked(s)
            sums.append(part.astype(float))
            first.append(np.unpackbits(np.frombuffer(f, np.uint8))[: len(part)].astype(bool))
        sums, first = np.concatenate(sums), np.concatenate(first)
        if order is None:
            return sums, first
        out, out_first = np.empty_like(sums), np.empty_like(first)
        out[order], out_first[order] = sums, first
        return out, out_first


def _walk(own: _Block, buckets: int, totals: tuple | None, depth: int, min_count: int, divergence: float, strength: float):
    """The rows this block asks next, or its documents' scores once everything is answered."""
    tokens, keys = own.tokens, own.vocabulary
    n = len(tokens)
    if totals is None:
        counts = np.bincount(tokens, weights=own.train, minlength=len(keys)).astype(np.int32)
        return _asked(0, own.block, keys, counts, buckets), None
    total, known, once, twice = totals
    count, _ = own.answer(0, None)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    root = np.where(count > 0, count - discount, discount * known) / max(total, 1)
    q = root[tokens]
    ends = np.cumsum(own.size)
    opens = np.zeros(n, bool)
    opens[0] = True
    opens[ends[:-1]] = True
    asks: list[tuple] = []
    kept = np.ones(n, bool)
    context = np.full(n, -1, np.int64)
    context[1:] = np.where(opens[1:], -1, tokens[:-1])
    context_count, context_key = count, mix(keys + _U(1))
    for d in range(1, depth + 1):
        at = np.flatnonzero((context >= 0) & (np.where(context >= 0, context_count[context], 0) >= min_count))
        grams, where, place = np.unique(context[at] * len(keys) + tokens[at], return_index=True, return_inverse=True)
        gram_context, gram_word = grams // len(keys), grams % len(keys)
        gram_key = mix(context_key[gram_context] * _U(0x9E3779B97F4A7C15) + keys[gram_word] + _U(d))
        order = np.argsort(gram_key, kind="stable")
        if 2 * d not in own.answers:
            mine = np.bincount(place, weights=own.train[at], minlength=len(grams)).astype(np.int32)
            asks += _asked(2 * d, own.block, gram_key[order], mine[order], buckets)
            break
        gram_count, first = own.answer(2 * d, order)
        above = context_count[gram_context] + strength
        suffix = q[at][where]
        p = (gram_count + strength * suffix) / above
        contexts, of = np.unique(gram_context, return_inverse=True)
        context_order = np.argsort(context_key[contexts], kind="stable")
        if 2 * d + 1 not in own.answers:
            left_out = np.maximum(gram_count - 1, 0) + strength * suffix
            gain = np.where(first & (gram_count > 0), gram_count * np.log(left_out / (above - 1) / suffix), 0.0)
            gains = np.bincount(of, weights=gain, minlength=len(contexts))
            asks += _asked(2 * d + 1, own.block, context_key[contexts][context_order], gains[context_order], buckets)
            stays = np.zeros(len(contexts), bool)
        else:
            gains, _ = own.answer(2 * d + 1, context_order)
            stays = gains >= divergence * context_count[contexts]
        stays_here = stays[of][place] & kept[at]
        kept = np.zeros(n, bool)
        kept[at] = stays_here
        q = q.copy()
        q[at] = np.where(stays_here, p[place], q[at])
        gram_at = np.full(n, -1, np.int64)
        gram_at[at] = place
        context = np.full(n, -1, np.int64)
        context[1:] = np.where(opens[1:], -1, gram_at[:-1])
        context_count, context_key = gram_count, gram_key
    if asks:
        return asks, None
    starts = ends - own.size
    base = np.log10((count + 1) / (total + known + 1))[tokens]
    score = np.log10(q) if total else np.zeros(n)
    sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64)[tokens], base, score)]
    return [], list(zip(own.doc_id, own.train_doc.tolist(), own.size.tolist(), sums[0].tolist(), sums[1].tolist(), sums[2].tolist(), strict=True))


def score(
    spark: SparkSession, docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, strength: float = STRENGTH,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    stage = Stage(spark, "pst")
    remainder = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (remainder != HELD).alias("train"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, answers = (f"pst_{what}_{uuid.uuid4().hex}" for what in ("blocks", "answers"))
    kept = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        # A block is one row, so a task writes as many files as it made blocks.
        cut = texts.mapInArrow(_cut, BLOCKS)
        cut.write.option("path", f"{stage.root}/blocks").option("compression", "zstd").bucketBy(parts, "block").format("parquet").saveAsTable(name)
        blocks = spark.table(name)
        n_blocks = blocks.select("block").count()
        buckets = max(parts, n_blocks)
        totals, settings = None, (depth, min_count, divergence, strength)
        for turn in range(depth + 2):
            had = spark.table(answers) if turn else spark.createDataFrame([], ANSWER)
            asked = blocks.groupBy("block").cogroup(had.where("block IS NOT NULL").groupBy("block")).applyInArrow(_asking(buckets, totals, settings), ASK)
            new = asked.groupBy("kind", "bucket").applyInArrow(_summed, ANSWER).repartition(parts, "block")
            new.write.option("path", f"{stage.root}/answers").mode("append").bucketBy(parts, "block").format("parquet").saveAsTable(answers)
            if totals is None:
                found = spark.table(answers).where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "known", "once", "twice")]).first()
                totals = tuple(int(x) for x in found)
        had = spark.table(answers).where("block IS NOT NULL")
        out = blocks.groupBy("block").cogroup(had.groupBy("block")).applyInArrow(_scoring(buckets, totals, settings), SCORE)
        out = stage.write(out, "scores")
    finally:
        for table in (name, answers):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.conf.unset(CLEAN_UP) if kept is None else spark.conf.set(CLEAN_UP, kept)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score")


def _asking(buckets, totals, settings):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table([], _ASK)
        return _table(_walk(_Block(row, answers), buckets, totals, *settings)[0], _ASK)

    return run


def _scoring(buckets, totals, settings):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table([], _SCORE)
        asks, rows = _walk(_Block(row, answers), buckets, totals, *settings)
        if asks:
            raise RuntimeError("a block still asks when it should score")
        return _table(rows, _SCORE)

    return run
