"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document is the set of its 4-word shingles, as 64-bit hashes. Two permutations of the 32-bit universe make
the whole signature: the first places the shingle, the second is shifted circularly by k for coordinate k,
so coordinate k is the smallest pi(sigma(x) + k). ``BANDS`` bands of ``ROWS`` coordinates give candidates: a
pair at Jaccard 0.8 is missed with a chance of (1 - 0.8**ROWS)**BANDS, 5e-6 here.

Documents with the same set are one class with its smallest doc_id, so copies make no pairs. In a bucket
every class is first held against the bucket's smallest one only; verified links are joined to components.
In buckets that still hold several components, classes outside the largest one are held against the bucket's
other components by a bound first: every set has a bitmap of the parities of its shingles' hashes, two sets differ
in at least as many shingles as their bitmaps in bits, and a pair goes on only if its sizes and that difference
allow the threshold. Links are confirmed on whole sets. No bucket is capped. Links and
components stay in tables; components are found by repeated hooking to the smallest neighbour.

Null texts and texts without words have no shingle and are linked with nothing. Fewer than four words are
one shingle, the whole sequence. Rows repeated with one doc_id are one document in the links, and each has
its row in the result. A null doc_id is a document of its own and never linked. Empty tables give empty
results. Extra columns are ignored by :func:`near_duplicates` and kept by :func:`keep_rows`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.words import Words, give_back, longs, mix, pieces
from contestry.session import Stage

SHINGLE, THRESHOLD = 4, 80
ROWS, BANDS = 6, 40
#: Shingles that a pass over the coordinates works on at a time (32 bits each, in cache).
BLOCK = 1 << 15
#: Longs of 64 bits in a set's bitmap.
MARKS = 16


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every document in ascending order, offsets)."""
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        rolled *= factor
        rolled[: max(0, n - j)] += hashes[j:]
    rolled = mix(rolled + np.uint64(size))
    out, ends = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        if b - a >= size:
            part = np.sort(rolled[a : b - size + 1])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif b > a:
            whole = int(b - a)
            for h in hashes[a:b].tolist():
                whole = (whole * int(factor) + h) & ((1 << 64) - 1)
            part = mix(np.array([whole], np.uint64))
        else:
            part = hashes[:0]
        out.append(part)
        ends[i + 1] = ends[i] + len(part)
    return (np.concatenate(out) if out else hashes[:0]), ends


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit values, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        x ^= spare
        x *= np.uint32(factor)
    np.right_shift(x, np.uint32(16), out=spare)
    x ^= spare
    return x


def signatures(sets: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates) of 32-bit minima; documents without shingles hold the largest value."""
    out = np.full((len(offsets) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    placed = (mix(sets ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    docs = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][docs]
    i = 0
    while i < len(docs):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a = starts[i]
        b = starts[j] if j < len(docs) else len(sets)
        if j == i + 1:
            for c in range(a, b, BLOCK):
                block = placed[c : min(b, c + BLOCK)]
                _minima(block, np.zeros(1, np.int64), out[docs[i] : docs[i] + 1], coordinates)
        else:
            part = np.full((j - i, coordinates), 0xFFFFFFFF, np.uint32)
            _minima(placed[a:b], starts[i:j] - a, part, coordinates)
            out[docs[i:j]] = part
        i = j
    return out


def _minima(block: np.ndarray, starts: np.ndarray, out: np.ndarray, coordinates: int) -> None:
    x, spare = np.empty_like(block), np.empty_like(block)
    for k in range(coordinates):
        np.add(block, np.uint32(k), out=x)
        np.minimum(out[:, k], np.minimum.reduceat(_pi(x, spare), starts), out=out[:, k])


def band_hashes(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(documents, bands) of 64-bit bucket hashes, the band's number in them."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        out = mix(out) + signature[:, r : rows * bands : rows].astype(np.uint64)
    return mix(out)


SKETCH = "doc_id long, n long, set_a long, set_b long, buckets array<long>"


def _sketch(size: int, rows: int, bands: int):
    def run(batches):
        words = Words()
        for batch in pieces(batches, "text", 1 << 20):
            sets, offsets = shingles(*words(batch.column("text")), size)
            keys = band_hashes(signatures(sets, offsets, rows * bands), rows, bands)
            n = np.diff(offsets)
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
                run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append(longs(run_[offsets[1:]] - run_[offsets[:-1]]))
            ends = np.arange(0, bands * len(n) + 1, bands, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(longs(keys).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists],
                names=["doc_id", "n", "set_a", "set_b", "buckets"],
            )
        give_back()

    return run


def _sets(size: int):
    def run(batches):
        words = Words()
        for batch in pieces(batches, "text", 1 << 20):
            sets, offsets = shingles(*words(batch.column("text")), size)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(longs(sets)))
            bits = np.zeros((len(offsets) - 1, 64 * MARKS), np.int64)
            np.add.at(bits, (np.repeat(np.arange(len(bits)), np.diff(offsets)), (sets % np.uint64(64 * MARKS)).astype(np.int64)), 1)
            marks = np.packbits((bits & 1).astype(np.uint8), axis=1).view(np.int64)
            marks = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, MARKS, dtype=np.int32)), pa.array(marks.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists, marks], names=["id", "shingles", "marks"])
        give_back()

    return run


def _confirm(threshold: int):
    """Pairs whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("set_x"), batch.column("set_y")
            xo, xv, yo, yv = (np.asarray(z) for z in (x.offsets, x.values, y.offsets, y.values))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= threshold * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) that are links."""
    with_x = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("set_x")), "x")
    both = with_x.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("set_y")), "y")
    return both.select("x", "y", "set_x", "set_y").mapInArrow(_confirm(threshold), "x long, y long")


def components(stage: Stage, links: DataFrame, name: str) -> DataFrame:
    """(id, component) of all linked ids: the smallest id that can be reached.

    Every edge is led to the smaller ends' neighbourhood minimum in turn (large star, then small star)
    until no edge changes; a round is one written table, its checksum decides.
    """
    edges = stage.write(links.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi <> lo").distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        turn += 1
        edges = stage.write(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), f"{name}-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return stage.write(edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots), f"{name}-components")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, rows: int = ROWS, bands: int = BANDS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. ``threshold`` is in percent."""
    stage = Stage(spark, "near-dedup")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketch = stage.write(texts.mapInArrow(_sketch(size, rows, bands), SKETCH), "sketch")
    # A class is all documents with one set; its sums and size are a 128-bit hash of the set.
    filled = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = stage.write(filled.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("class")), "classes")
    leaders = filled.join(classes.select(F.col("class").alias("doc_id"), "set_a", "set_b", "n"), ["doc_id", "set_a", "set_b", "n"], "left_semi")
    entries = leaders.select(F.col("doc_id").alias("id"), "n", F.explode("buckets").alias("bucket"))
    least = entries.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead")
    members = stage.write(entries.join(least, "bucket"), "members")
    wanted = stage.write(members.select("id").distinct(), "wanted")
    sets = stage.write(
        texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets(size), "id long, shingles array<long>, marks array<long>"), "sets"
    )
    star = members.where("id <> lead").select(F.col("lead").alias("x"), F.col("id").alias("y")).distinct()
    links = stage.write(confirmed(star, sets, threshold), "star-links")
    found = components(stage, links, "star")
    more = stage.write(confirmed(_open_pairs(stage, members, found, sets, threshold), sets, threshold), "open-links")
    if more.take(1):
        found = components(stage, links.unionByName(more), "all")
    linked = classes.join(found.withColumnRenamed("id", "class"), "class", "left").select("set_a", "set_b", F.col("n"), F.coalesce("component", "class").alias("component"))
    out = sketch.drop("buckets").join(linked, ["set_a", "set_b", "n"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _open_pairs(stage: Stage, members: DataFrame, found: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs of a bucket that no component joins and that sizes and bitmaps allow: outside its largest component against the others."""
    known = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    known = known.join(largest.select("bucket", F.col("m.component").alias("main")), "bucket").join(sets.select("id", "marks"), "id")
    known = stage.write(known.select("bucket", "id", "n", "component", "main", "marks"), "opened")
    outside = known.where("component <> main").select("bucket", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("marks").alias("my"))
    differ = sum((F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("my", F.lit(i)))) for i in range(MARKS)), F.lit(0))
    # With d shingles in one set only, the intersection is (n + ny - d) / 2 and the union (n + ny + d) / 2.
    total = F.col("n") + F.col("ny")
    pairs = known.join(outside, "bucket").where(
        (F.col("component") != F.col("cy")) & ((F.col("component") == F.col("main")) | (F.col("id") < F.col("y")))
        & (100 * F.least("n", "ny") >= threshold * F.greatest("n", "ny")) & (100 * (total - differ) >= threshold * (total + differ))
    )
    return pairs.select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")).distinct()


def keep_rows(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest, all columns kept."""
    gone = near_duplicates(spark, docs, doc_id=doc_id, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Stage(spark, "near-dedup").write(gone, "gone")
    # The row travels as one struct, so its columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_own"))
    return rows.join(gone, F.col("_own") == F.col("_gone"), "left_anti").select("_row.*")
