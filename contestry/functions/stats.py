"""Closed-form statistics as Column expressions; they stay inside whole-stage codegen."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_975 = NormalDist().inv_cdf(0.975)
DIFF_Z = 1.96  # fixed value: difference intervals use the rounded constant


def r6(c, digits: int = 6) -> Column:
    """Round for comparison and never return negative zero."""
    c = F.round(c.cast("double") if isinstance(c, Column) else F.col(c).cast("double"), digits)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def wilson(successes: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; NULL at n = 0."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    nn = F.when(n > 0, n.cast("double"))
    p = successes.cast("double") / nn
    denom = 1 + z * z / nn
    centre = (p + z * z / (2 * nn)) / denom
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / denom
    low, high = centre - half, centre + half
    return (
        F.when(nn.isNotNull(), F.greatest(F.lit(0.0), low)),
        F.when(nn.isNotNull(), F.least(F.lit(1.0), high)),
    )


def minimum_detectable_effect(n: Column, p0: float = 0.5, alpha: float = 0.05, power: float = 0.8) -> Column:
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return F.when(n > 0, F.lit(za + zb) * F.sqrt(F.lit(p0 * (1 - p0)) / n.cast("double")))


def shrink(total: Column, n: Column, prior, m: float) -> Column:
    """(total + m·prior) / (n + m), and the prior where there is no weight at all.

    Serves both the shrunk rate and the shrunk mean.
    """
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    weight = n.cast("double") + F.lit(float(m))
    return F.when(weight <= 0, prior).otherwise(
        (total.cast("double") + F.lit(float(m)) * prior) / F.when(weight > 0, weight)
    )


def two_proportion(s_a: Column, n_a: Column, s_b: Column, n_b: Column) -> dict[str, Column]:
    """Pooled z statistic with an unpooled interval on the difference."""
    pa, pb = ratio(s_a, n_a), ratio(s_b, n_b)
    pooled = ratio(s_a + s_b, n_a + n_b)
    inv = 1 / n_a.cast("double") + 1 / n_b.cast("double")
    ok = (n_a > 0) & (n_b > 0)
    se_pooled = F.when(ok, F.sqrt(pooled * (1 - pooled) * F.when(ok, inv)))
    se = F.sqrt(pa * (1 - pa) / F.when(ok, n_a.cast("double")) + pb * (1 - pb) / F.when(ok, n_b.cast("double")))
    diff = pa - pb
    z = F.when(ok, F.when(se_pooled > 0, diff / F.when(se_pooled > 0, se_pooled)).otherwise(0.0))
    return {
        "rate_a": F.when(ok, pa), "rate_b": F.when(ok, pb), "diff": diff,
        "ci_low": diff - DIFF_Z * se, "ci_high": diff + DIFF_Z * se, "z": z,
    }


def clip(p: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def log_loss_row(y: Column, p: Column, eps: float = 1e-12) -> Column:
    q = clip(p.cast("double"), eps)
    y = y.cast("double")
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elo_expected(diff: Column, scale) -> Column:
    """Win probability for a rating difference (home bonus already added)."""
    return 1 / (1 + F.pow(F.lit(10.0), -diff / scale))
