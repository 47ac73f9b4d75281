"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words (white-space tokens) weighted by how often they occur. For each coordinate and word
a hash gives r and c, gamma distributed with shape 2, and b uniform in [0, 1). With t = floor(ln w / r + b)
the word's sample is c * exp(-r * (t - b + 1)); the coordinate is the smallest sample over the words. A
sample depends on w through t only, and t is shared over a range of weights: two documents agree in a
coordinate exactly when the same word wins at the same t, whose chance is the generalised Jaccard similarity
(sum of smaller weights by sum of larger ones). So the share of equal coordinates estimates it.

Rows are dealt by sampled ranges of (doc_id, hash of the text) and written; the first row of a range also goes
to the range before it as a guest, so every row finds its successor in its own partition, however uneven the ids. Words are counted
inside their row, by a sort of their hashes, and folded to the row's minima without another shuffle.

Null texts count as empty. A text without words has no signature: its likeness is 1 to another such text
and 0 to any other. Rows repeated with one doc_id follow each other in the order of their texts. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.words import SPACE_CLASS
from contestry.session import Stage

COORDINATES = 32
#: Ranges of ids for each shuffle partition of the session; the first id of every range is broadcast.
RANGES = 4
#: Spark's setting that removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A text's smallest sample is exponential with the rate of its total weight: it exceeds this many means
#: with a chance of exp(-24), and terms that are sure to exceed it are passed over without a logarithm.
MEANS = 24.0


def _sample(k: int) -> Column:
    """The sample of (term, log_w) in coordinate ``k``, smaller wins; null if it is above ``cap``.

    With r = -ln x and c = -ln z a sample is at least c * x / w, and -ln z is at least 2 (1 - z) / (1 + z).
    """
    low = lambda h, at: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 26) - 1)) + F.lit(0.5)) * F.lit(2.0**-26)
    a, b = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
    x, z = low(a, 0) * low(a, 26), low(b, 0) * low(b, 26)
    r, c = -F.log(x), -F.log(z)
    u = (F.shiftrightunsigned(a, 52) * F.lit(4096) + F.shiftrightunsigned(b, 52)) * F.lit(2.0**-24)
    sample = c * F.exp(-r * (F.floor(F.col("log_w") / r + u) - u + F.lit(1.0)))
    return F.when(x * (F.lit(1.0) - z) * F.lit(2.0) <= F.col("cap") * (z + F.lit(1.0)), sample)


def with_terms(rows: DataFrame, text: str) -> DataFrame:
    """A row for each distinct word of ``text``: its hash, the log of its count, the cap; one null row if it has none."""
    words = F.filter(F.split(F.col(text), SPACE_CLASS + "+"), lambda w: w != "")
    rows = rows.withColumn("_h", F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))).drop(text)
    first = lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1))
    at = F.when(F.size("_h") > 0, F.filter(F.sequence(F.lit(0), F.size("_h") - 1), first)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_at", at)
    ends = F.concat(F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_h")))
    terms = F.zip_with("_at", ends, lambda a, b: F.struct(F.get("_h", a).alias("term"), (b - a).cast("double").alias("w")))
    rows = rows.withColumns({"_t": F.explode_outer(terms), "_n": F.size("_h")})
    columns = {"term": F.col("_t.term"), "log_w": F.log("_t.w"), "cap": F.col("_t.w") * F.lit(MEANS) / F.col("_n")}
    return rows.withColumns(columns).drop("_h", "_at", "_t", "_n")


def signatures(rows: DataFrame, text: str, keys: list[str], coordinates: int = COORDINATES) -> DataFrame:
    """``keys`` and ``sig``, an array of ``coordinates`` ints; null for a text without words."""
    minima = with_terms(rows, text).groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), _sample(k))).alias(f"_m{k}") for k in range(coordinates)])
    code = lambda k: F.xxhash64(f"_m{k}").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return minima.select(*keys, F.when(F.col("_m0").isNotNull(), F.array(*[code(k) for k in range(coordinates)])).alias("sig"))


def likeness(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(coordinates))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def as_text(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def _ranged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, text, guest, cell): every cell ends with a guest, its last row's successor."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(1 << 63)).cast("long")  # null ids come first
    # Equal rows may lie in any order, so a draw parts a large group of them.
    dealt = docs.withColumn("i", F.coalesce("doc_id", low)).repartitionByRange(RANGES * parts, "i", "h", F.rand(7))
    kept = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        rows = Stage(spark, "fingerprint").write(dealt.withColumn("cell", F.spark_partition_id()), "rows")
    finally:
        spark.conf.unset(CLEAN_UP) if kept is None else spark.conf.set(CLEAN_UP, kept)
    heads = rows.groupBy("cell").agg(F.min(F.struct("i", "h")).alias("head"))
    order = Window.orderBy("cell")  # over the cells' heads only
    heads = heads.select("cell", "head.i", "head.h", F.lag("cell").over(order).alias("_to"), F.max("cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    guests = rows.join(F.broadcast(heads), ["cell", "i", "h"]).groupBy(F.coalesce("_to", "_last").alias("cell")).agg(F.first("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), "text", F.lit(True).alias("guest"), "cell")
    out = rows.select("doc_id", "h", "text", F.lit(False).alias("guest"), "cell").unionByName(guests)
    return out.repartition(parts, "cell")


def fingerprints(spark: SparkSession, docs: DataFrame, coordinates: int = COORDINATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as
    many of the next document.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = _ranged(spark, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text")))
    order = Window.partitionBy("cell").orderBy("guest", "doc_id", "h")
    rows = rows.withColumns({"_next": F.lead("text").over(order), "rn": F.row_number().over(order), "n_chars": F.char_length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    sides = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))
    )
    keys = ["cell", "rn", "side", "guest", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select("cell", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.explode(sides).alias("_s"))
    sigs = signatures(both.select("*", F.col("_s.side").alias("side"), F.col("_s.body").alias("body")).drop("_s"), "body", keys, coordinates)
    order = Window.partitionBy("cell").orderBy("rn", "side")
    sigs = sigs.withColumns({"_edited": F.lead("sig", 1).over(order), "_next": F.lead("sig", 2).over(order)}).where("side = 0 AND NOT guest")
    return sigs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("_edited"), coordinates).alias("near_edited"), likeness(F.col("sig"), F.col("_next"), coordinates).alias("near_next"),
    )
