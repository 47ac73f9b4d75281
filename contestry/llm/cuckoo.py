"""Exact dedup over a sharded cuckoo-filter index of live digests.

The digest of a text is the SHA-256 of the text without white space, taken by Spark. Digests are dealt
to shards; each shard is one :class:`Cuckoo` table. A slot holds a 16-bit tag and the number of the
stored record, so a tag hit is checked against the full digest kept for that bucket. An insertion that
finds no free slot doubles the table and rebuilds it from the stored digests.

Copies are folded twice by the same table: once per scan task, so that a group with a third of all rows
leaves each task as one record, and once per shard. Shards are sized by the number of rows.

Null texts count as empty; all empty texts are equal. Of a group the row with the most code points
stays, then the smallest doc_id (a null doc_id last). Rows repeated with one doc_id count as copies;
:func:`dedup` marks all that agree with the best row in doc_id and length, :func:`keep_rows` keeps one of them. An empty table gives an empty result. Extra columns are ignored by :func:`dedup` and kept by :func:`keep_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.words import SPACE
from contestry.session import Stage

SLOTS = 4
MAX_KICKS = 256
SHARD_ROWS = 200_000
RECORD = "digest binary, n_chars long, doc_id long, copies long"
INDEX = "shard int, buckets int, digest binary, n_chars long, doc_id long, copies long"


class Cuckoo:
    """Digests with a record each: (code points of the best row, its doc_id, live copies)."""

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes] = []
        self.records: list[tuple | None] = []
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.n = buckets
        self.tags = np.zeros((buckets, SLOTS), np.uint16).tolist()
        self.rows = np.full((buckets, SLOTS), -1).tolist()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        a = int.from_bytes(digest[:8], "little") % self.n
        return tag, a, self._other(a, tag)

    def _other(self, bucket: int, tag: int) -> int:
        """Its own inverse: a tag's two buckets lead to each other."""
        return ((tag * 0x5BD1E995 >> 3) - bucket) % self.n

    def find(self, digest: bytes) -> tuple[int, int, int] | None:
        """(bucket, slot, stored row) of a digest whose stored content agrees, else None."""
        tag, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            for slot in range(SLOTS):
                row = self.rows[bucket][slot]
                if row >= 0 and self.tags[bucket][slot] == tag and self.digests[row] == digest:
                    return bucket, slot, row
        return None

    def _place(self, row: int) -> bool:
        tag, a, b = self._places(self.digests[row])
        for bucket in (a, b):
            if -1 in self.rows[bucket]:
                slot = self.rows[bucket].index(-1)
                self.tags[bucket][slot], self.rows[bucket][slot] = tag, row
                return True
        bucket = b
        for kick in range(MAX_KICKS):
            slot = (tag + kick) % SLOTS
            tag, self.tags[bucket][slot] = self.tags[bucket][slot], tag
            row, self.rows[bucket][slot] = self.rows[bucket][slot], row
            bucket = self._other(bucket, tag)
            if -1 in self.rows[bucket]:
                slot = self.rows[bucket].index(-1)
                self.tags[bucket][slot], self.rows[bucket][slot] = tag, row
                return True
        return False

    def _resize(self) -> None:
        live = [i for i, r in enumerate(self.records) if r is not None]
        self.digests, self.records = [self.digests[i] for i in live], [self.records[i] for i in live]
        buckets = self.n
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(self._place(i) for i in range(len(self.digests))):
                return

    def insert(self, digest: bytes, n_chars: int, doc_id: int | None, copies: int = 1) -> None:
        hit = self.find(digest)
        if hit:
            row = hit[2]
            best = min(self.records[row][:2], (n_chars, doc_id), key=_rank)
            self.records[row] = (*best, self.records[row][2] + copies)
            return
        self.digests.append(digest)
        self.records.append((n_chars, doc_id, copies))
        if not self._place(len(self.digests) - 1):
            self._resize()

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """Take live copies away; the slot is freed with the last one. False if it is not there."""
        hit = self.find(digest)
        if not hit:
            return False
        bucket, slot, row = hit
        n_chars, doc_id, live = self.records[row]
        if live > copies:
            self.records[row] = (n_chars, doc_id, live - copies)
        else:
            self.records[row] = None
            self.tags[bucket][slot], self.rows[bucket][slot] = 0, -1
        return True

    def items(self) -> Iterator[tuple]:
        for digest, record in zip(self.digests, self.records, strict=True):
            if record is not None:
                yield digest, *record


def _rank(x: tuple) -> tuple:
    return -x[0], x[1] is None, x[1] or 0


def _table(items, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*items, strict=True), schema.types, strict=True)] if items else [pa.array([], t) for t in schema.types], schema=schema)


_RECORD = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64())])
_INDEX = pa.schema([("shard", pa.int32()), ("buckets", pa.int32()), *_RECORD])
#: Records that a scan task holds before it hands them on.
TASK_ROWS = 100_000


def _fold(batches):
    """A task's rows folded by a local index: one record for each digest it met."""
    index = Cuckoo()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_chars", "doc_id")), strict=True):
            index.insert(*row)
        if len(index.digests) >= TASK_ROWS:
            yield from _table(list(index.items()), _RECORD).to_batches()
            index = Cuckoo()
    yield from _table(list(index.items()), _RECORD).to_batches()


def _load(table: pa.Table) -> Cuckoo:
    """A stored shard as an index again, in its stored size."""
    index = Cuckoo(max([64, *table["buckets"].to_pylist()]))
    for row in zip(*(table[c].to_pylist() for c in ("digest", "n_chars", "doc_id", "copies")), strict=True):
        index.insert(*row)
    return index


def _merge_shard(key, stored: pa.Table, changes: pa.Table) -> pa.Table:
    """Deletions of a batch go first, then its insertions."""
    index = _load(stored)
    rows = list(zip(*(changes[c].to_pylist() for c in ("digest", "n_chars", "doc_id", "copies")), strict=True))
    for row in rows:
        if row[3] < 0:
            index.delete(row[0], -row[3])
    for row in rows:
        if row[3] > 0:
            index.insert(*row)
    return _table([(key[0].as_py(), index.n, *x) for x in index.items()], _INDEX)


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.translate(body, SPACE, ""), "UTF-8"), 256))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, digest) of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.char_length(body).cast("long").alias("n_chars"),
        _digest(body).alias("digest"),
    )


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def update(index: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None = None, shards: int = 16) -> DataFrame:
    """The index after a batch. ``inserts`` and ``deletes`` come from :func:`digests`.

    ``shards`` must stay the same over an index's life; a shard grows by doubling its table. A deleted
    row that was the best of its group leaves the record's best as it was until the digest is gone.
    """
    parts = []
    if inserts is not None:
        parts.append(inserts.mapInArrow(_fold, RECORD))
    if deletes is not None:
        parts.append(deletes.mapInArrow(_fold, RECORD).withColumn("copies", -F.col("copies")))
    changes = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    changes = changes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_merge_shard, INDEX)


def _indexed(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows, and one record for each distinct digest."""
    stage = Stage(spark, "exact-dedup")
    rows = stage.write(digests(docs, doc_id, text), "digests")
    shards = max(1, -(-rows.count() // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = stage.write(update(empty_index(spark), rows, shards=shards), "index")
    return rows, index.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.col("n_chars").alias("keep_chars"))


def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = _indexed(spark, docs, doc_id, text)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", same.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_rows(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group with all its columns: of the rows like the best in doc_id and length, the first by a hash of the row's columns, whatever their names."""
    rows, groups = _indexed(spark, docs, doc_id, text)
    best = groups.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_id"), F.col("keep_chars").alias("_chars"))

    def alike(digest, own_id, chars):
        return (digest == F.col("_digest")) & own_id.eqNullSafe(F.col("_id")) & (chars == F.col("_chars"))

    found = rows.join(best, alike(F.col("digest"), F.col("doc_id"), F.col("n_chars"))).groupBy("_digest", "_id", "_chars").agg(F.count(F.lit(1)).alias("_n"))
    best = Stage(spark, "exact-dedup").write(found, "best")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # The row travels as one struct, so its columns may have any names.
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    with_keys = docs.select(columns, _digest(body).alias("_sha"), F.col(doc_id).cast("long").alias("_own"), F.char_length(body).cast("long").alias("_length"))
    same = alike(F.col("_sha"), F.col("_own"), F.col("_length"))
    kept = with_keys.join(best.where("_n = 1"), same, "left_semi").select("_row.*")
    repeated = best.where("_n > 1")
    if repeated.isEmpty():
        return kept
    one = with_keys.join(repeated, same, "left_semi").groupBy("_sha").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return kept.union(one.select("_row.*"))
