"""Line dedup over levelled sorted runs of line hashes.

A run holds (128-bit hash of a line's key, documents that have the line) in a table bucketed and sorted by the
hash. A batch of documents is counted into a table bucketed alike and merge-anti-joined with every run, bucket by
bucket and without a shuffle: its unseen keys become a run of level 0, the counts of the others a delta. When a level
holds ``FANOUT`` runs they are merged into one run of the next level, so a key is rewritten only as often as there
are levels; deltas are levelled alike. A key's documents are the sum over its run and the deltas.

Two different keys of one corpus share their 128 bits with a chance below 1e-14 even at 1e12 keys.

A document is cut at \\n; null or empty text is one empty line. A key is the line without white space at
both ends, A-Z folded. A key shorter than ``min_chars`` code points is never dropped. A key counts once for
each document. Rows are told apart by (doc_id, text): repeated rows count as one document and get equal
results. Empty tables give empty results. Extra columns are ignored by :func:`drop_lines`.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.words import SPACE
from contestry.session import Stage

FANOUT = 4
BATCHES = 6
KEY = ["h1", "h2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, pos, h1, h2): a row for each line with a key: the hash of doc_id and text, the line's place, the key's hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(row_key(docs, doc_id, text).alias("row"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    rows = rows.select("row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # The second half starts from another seed, so the halves do not depend on each other.
    return rows.select("row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def row_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


class LineRuns:
    """The levelled runs of one index: tables bucketed and sorted by key in the shared folder.

    ``levels`` hold the runs of keys, each key in one run only, with the documents of the batch that brought it;
    ``deltas`` hold, levelled alike, what later batches add to keys that a run has.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.stage = Stage(spark, "line-runs")
        # As many buckets as shuffle partitions: an aggregate by key leaves a bucket in one file.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []  # names of tables
        self.deltas: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, counts: DataFrame, kind: str) -> str:
        name = f"{kind}_{len(self.tables)}_{uuid.uuid4().hex}"
        writer = counts.select(*KEY, "docs").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{self.stage.root}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        """(key, docs) over tables, read as plain files: Spark 4.1 takes a union of bucketed tables for
        co-partitioned even where it then reads them without their buckets, and a key would be left in two groups."""
        files = self.spark.read.schema("h1 long, h2 long, docs long").parquet(*[f"{self.stage.root}/{n}" for n in names])
        return files.groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def _insert(self, run: str, levels: list[list[str]], kind: str) -> None:
        level = 0
        while True:
            if len(levels) <= level:
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            run = self._write(self._merge(levels[level]), kind)
            levels[level] = []
            level += 1

    def add(self, distinct: DataFrame) -> None:
        """Add a batch from its (row, key), each once: its unseen keys as a run, the others' counts as a delta."""
        name = self._write(distinct.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs")), "batch")
        if not self.runs():
            return self._insert(name, self.levels, "run")
        counts = self.spark.table(name)
        fresh = self._write(self.unseen(counts), "run")
        known = self._write(counts.join(self.spark.table(fresh).hint("merge"), KEY, "left_anti"), "delta")
        self._insert(fresh, self.levels, "run")
        self._insert(known, self.deltas, "delta")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self) -> DataFrame:
        """(key, docs) over all runs and deltas."""
        names = [name for level in self.levels + self.deltas for name in level]
        return self._merge(names) if names else self.spark.createDataFrame([], "h1 long, h2 long, docs long")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds: a merge anti join, bucket by bucket, for each run."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), KEY, "left_anti")
        return keys

    def close(self) -> None:
        """Forget the tables; their files stay with the stage."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _cut(with_text: bool):
    schema = _OUT if with_text else pa.schema(list(_OUT)[:4])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, drop in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "drop")), strict=True):
                lines = (text or "").split("\n")
                gone = set(drop or ())
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                out.append((doc_id, len(lines), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def drop_lines(
    spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text",
    with_text: bool = False, fanout: int = FANOUT,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text).

    Lines whose key stands in ``min_docs`` documents lose all their lines. The table is fed to the runs in
    ``batches`` parts, as a growing corpus would be; the lines are read from the text once and written. The
    number of batches is the same at every size: every batch reads all runs, so batches of a fixed size would
    read them as often as there are batches.
    """
    stage = Stage(spark, "line-dedup")
    lines = line_hashes(docs, min_chars, doc_id, text).withColumn("batch", F.pmod("row", F.lit(batches)).cast("int"))
    lines.write.partitionBy("batch").parquet(f"{stage.root}/lines")  # a batch reads its own files
    lines = spark.read.schema(lines.schema).parquet(f"{stage.root}/lines")
    index = LineRuns(spark, fanout)
    for i in range(batches):
        # A document's lines stand in one task, so equal lines of one document fold before the shuffle.
        index.add(lines.where(F.col("batch") == i).select("row", *KEY).distinct())
    common = stage.write(index.merged().where(F.col("docs") >= min_docs).select(*KEY), "common")
    drops = lines.join(common, KEY, "left_semi").groupBy("row").agg(F.collect_set("pos").alias("drop"))
    body = docs.select(row_key(docs, doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drops = stage.write(drops, "drops")
    index.close()
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    # Merged at every size: a broadcast of the drops would end where the corpus grows.
    return body.join(drops.hint("merge"), "row", "left").select("doc_id", "text", "drop").mapInArrow(_cut(with_text), schema)
