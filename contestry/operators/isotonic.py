"""Isotonic regression by pools that merge: any number of fits, no pool on the driver before it is final.

Rows fold to one point a distinct forecast, with the weight and the sum of outcomes of every fit side by side. Points
are dealt by ranges of the forecast; a partition pools its own violators, and neighbouring ranges are merged in a tree.
Pooling adjacent violators in any order gives the same solution, so a merge needs the pools alone. With outcomes of zero
and one the pools of n rows have different means with denominators that sum to n, so there are at most some n**(2/3)
of them, about n**(1/3) on forecasts that are not fitted to order; ``digits`` bounds them by 10**digits.

Rows with a null or NaN forecast or a null outcome are left out. A fit without rows has no pools. Pools with equal means are one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from contestry.session import Stage

POOLS = "fit int, block int, lo double, hi double, weight double, total double"
_COLUMNS = ["lo", "hi", "weight", "total"]
MERGED = 16  # neighbouring ranges merged in one task


def pool(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pools of points or pools in the order of their forecasts: means rise strictly.

    Each pass pools every stretch of means that do not rise, which are adjacent violators, until none is left.
    """
    while len(lo) > 1:
        mean = total / weight
        starts = np.flatnonzero(np.concatenate(([True], mean[1:] > mean[:-1])))
        if len(starts) == len(lo):
            break
        ends = np.concatenate((starts[1:], [len(lo)])) - 1
        lo, hi, weight, total = lo[starts], hi[ends], np.add.reduceat(weight, starts), np.add.reduceat(total, starts)
    return lo, hi, weight, total


def _pooled_points(fits: int):
    def run(frames):
        kept: list[list] = [[] for _ in range(fits)]
        block = TaskContext.get().partitionId()
        for x in frames:  # batches of a sorted partition; what is kept between them are pools
            p = x["p"].to_numpy()
            w, s = np.stack(x["w"].to_numpy()).astype(float), np.stack(x["s"].to_numpy()).astype(float)
            for i in range(fits):
                own = w[:, i] > 0
                points = (p[own], p[own], w[own, i], s[own, i])
                kept[i] = list(pool(*(np.concatenate(c) for c in zip(kept[i], points, strict=True)))) if kept[i] else list(pool(*points))
        for i, pools in enumerate(kept):
            if pools and len(pools[0]):
                yield pd.DataFrame({"fit": i, "block": block, **dict(zip(_COLUMNS, pools, strict=True))})

    return run


def _merged(key, x: pd.DataFrame) -> pd.DataFrame:
    x = x.sort_values("lo")
    return pd.DataFrame({"fit": key[0], "block": key[1], **dict(zip(_COLUMNS, pool(*(x[c].to_numpy() for c in _COLUMNS)), strict=True))})


def isotonic_pools(df: DataFrame, members: Sequence[Column], p: str = "p", y: str = "y", digits: int | None = None) -> DataFrame:
    """(fit, lo, hi, weight, value): the pools of one fit for each condition in ``members``, which may overlap.

    Rows are aggregated by forecast before they move, and move once whatever the number of fits.
    """
    stage = Stage(df.sparkSession, "isotonic")
    at = F.col(p).cast("double") if digits is None else F.round(F.col(p).cast("double"), digits)
    x = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull())
    x = x.select(at.alias("p"), F.col(y).cast("double").alias("y"), *[m.alias(f"m{i}") for i, m in enumerate(members)])
    fits = range(len(members))
    sums = [F.sum(F.when(F.col(f"m{i}"), F.lit(1.0)).otherwise(0.0)).alias(f"w{i}") for i in fits]
    sums += [F.sum(F.when(F.col(f"m{i}"), F.col("y")).otherwise(0.0)).alias(f"s{i}") for i in fits]
    points = x.groupBy("p").agg(*sums).select("p", F.array(*[f"w{i}" for i in fits]).alias("w"), F.array(*[f"s{i}" for i in fits]).alias("s"))
    ranged = points.repartitionByRange("p").sortWithinPartitions("p")
    pools = stage.write(ranged.mapInPandas(_pooled_points(len(members)), POOLS), "pools")
    last = pools.agg(F.max("block")).first()[0] or 0
    level = 0
    while last > 0:
        last //= MERGED
        grouped = pools.withColumn("block", F.floor(F.col("block") / MERGED).cast("int")).groupBy("fit", "block")
        level += 1
        pools = stage.write(grouped.applyInPandas(_merged, POOLS), f"level{level}")
    return pools.select("fit", "lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))


def knots(pools: DataFrame, fits: int) -> list[list[tuple[float, float]]]:
    """The final pools of each fit as points to interpolate between: the two ends of every pool."""
    out: list[list[tuple[float, float]]] = [[] for _ in range(fits)]
    for r in pools.orderBy("fit", "lo").toLocalIterator():
        out[r.fit] += [(r.lo, r.value)] if r.lo == r.hi else [(r.lo, r.value), (r.hi, r.value)]
    return out


def interpolated(p: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between the points and constant beyond them; null forecasts stay null."""
    xs, ys = np.array([a for a, _ in points]), np.array([b for _, b in points])

    @pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v, xs, ys)).where(v.notna().to_numpy())

    return at(p)
