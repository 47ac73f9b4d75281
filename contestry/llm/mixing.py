"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is what brings its share of the output to its weight: rate = weight / (sum of weights) *
total rows wanted / rows of the source. A document's count is the inverse of the Poisson distribution with
that mean at a uniform number that is a hash of (seed, doc_id, text), so a retried task draws the same
counts and no state is kept. The distribution is summed in logs over the steps within 12 deviations of the mean,
so that it holds at any rate. Rows are exploded by their counts and dealt to partitions and ordered inside
them by a hash of (seed, row, copy): a global shuffle that reads the text once and needs no range sample.

Null sources form a source of their own; sources without a weight take weight 1, or a stated default.
Weights of sources that do not occur are ignored. Empty and null texts are mixed like others. Repeated rows
draw the same count each. An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.session import Stage

#: Steps of the inverse beyond the mean, in standard deviations; the tail left out is below 2**-52.
TAIL = 12.0


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1): the first 52 bits of an MD5 over the parts, joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(table: DataFrame, key: str = "_source", rate: str = "rate") -> DataFrame:
    """``table`` with _low, the first step kept, and _cdf, P(X <= k) of a Poisson variable for k = _low, _low + 1, ... as an array."""
    mean, wide = F.col(rate), F.sqrt(rate) * TAIL + TAIL * 2
    low = F.greatest(F.floor(mean - wide), F.lit(0)).cast("long")
    high = F.when(mean > 0, F.ceil(mean + wide)).otherwise(F.lit(0)).cast("long")
    each = table.withColumn("_low", low).withColumn("_k", F.explode(F.sequence("_low", high)))
    whole = Window.partitionBy(key)
    so_far = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    # log of P(k) / P(low) is the sum of log(rate / j) over low < j <= k
    each = each.withColumn("_log", F.sum(F.when(F.col("_k") > F.col("_low"), F.log(mean / F.col("_k"))).otherwise(F.lit(0.0))).over(so_far))
    each = each.withColumn("_p", F.exp(F.col("_log") - F.max("_log").over(whole)))
    each = each.withColumn("_c", F.sum("_p").over(so_far) / F.sum("_p").over(whole))
    steps = F.array_sort(F.collect_list(F.struct("_k", "_c")))["_c"]
    return each.groupBy(*table.columns, "_low").agg(steps.alias("_cdf"))


def rates(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str) -> DataFrame:
    """(source, n_docs, rate, low, cdf): one row for each source, written so that its size is known to the join."""
    key = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")
    counts = Stage(spark, "mixing").write(docs.select(key).groupBy("_source").agg(F.count(F.lit(1)).alias("_n")), "counts")
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("_source") == (name or ""), F.lit(float(value))).otherwise(w)
    counts = counts.withColumn("_w", w)
    rows, weight = counts.agg(F.sum("_n"), F.sum("_w")).first()
    wanted = float(total if total is not None else rows or 0)
    rate = F.col("_w") / F.lit(float(weight or 1)) * F.lit(wanted) / F.col("_n")
    return Stage(spark, "mixing").write(distribution(counts.withColumn("rate", rate)), "rates")


def replicate(
    spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17,
    source: str = "source", doc_id: str = "doc_id", text: str = "text", numbered: bool = False,
) -> DataFrame:
    """``docs`` with every row as often as its Poisson count says, globally shuffled.

    ``numbered`` adds copy_no (from 1), n_copies and rate. Column names with a leading underscore are the operator's own.
    """
    table = rates(spark, docs, weights, total, source).select("_source", "rate", "_low", "_cdf")
    u = uniform(seed, doc_id, F.md5(F.coalesce(F.col(text), F.lit(""))))
    columns = [F.col(f"_d.`{c}`").alias(c) for c in docs.columns]
    drawn = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), u.alias("_u"))
    drawn = drawn.join(table, "_source").withColumn("_count", (F.col("_low") + F.size(F.filter("_cdf", lambda p: p <= F.col("_u")))).cast("int"))
    copies = drawn.where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    copies = copies.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_u"), F.col("_copy"), F.lit("order")))
    extra = [F.col("_copy").cast("long").alias("copy_no"), F.col("_count").cast("long").alias("n_copies"), "rate"] if numbered else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.select(*columns, *extra, "_order").repartition(parts, "_order").sortWithinPartitions("_order").drop("_order")
