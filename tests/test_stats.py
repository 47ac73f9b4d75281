import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contestry.functions import stats, tails
from contestry.operators.records import chi_square, holm
from contestry.operators.trends import mann_whitney


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_wilson_golden(spark):
    lo, hi = stats.wilson(F.lit(148), F.lit(264))
    assert one(spark, lo) == pytest.approx(0.500292, abs=1e-6)
    assert one(spark, hi) == pytest.approx(0.619181, abs=1e-6)
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    assert one(spark, lo) is None and one(spark, hi) is None
    assert one(spark, stats.wilson(F.lit(0), F.lit(10))[0]) == pytest.approx(0, abs=1e-12)
    assert one(spark, stats.wilson(F.lit(10), F.lit(10))[1]) == 1.0


def test_published_rates():
    assert tails.binom_two_sided(628, 1218) == pytest.approx(0.29, abs=0.005)
    assert tails.binom_two_sided(666, 1218) == pytest.approx(0.001, abs=0.0005)


def test_binomial_against_enumeration():
    for n, p in itertools.product((1, 2, 7, 30), (0.5, 0.3, 0.45)):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in range(n + 1):
            want = min(1.0, sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7)))
            assert tails.binom_two_sided(k, n, p) == pytest.approx(want, abs=1e-9), (k, n, p)


def test_tails_against_integrals():
    def integral(f, a, b, n=20000):
        h = (b - a) / n
        return h / 3 * sum(f(a + i * h) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1))

    for t, df in ((0.5, 3.0), (2.1, 10.0), (1.0, 250.0)):
        dens = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert tails.t_two_sided(t, df) == pytest.approx(1 - 2 * integral(dens, 0, t), abs=1e-9)
    for x in (0.5, 2.0, 9.0, 40.0):
        assert tails.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=1e-12)
        assert tails.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), abs=1e-12)


def test_exact_mann_whitney_counts_subsets():
    values = list(range(7))
    us = []
    for a in itertools.combinations(values, 3):
        us.append(sum(1 for x in a for y in values if y not in a and x > y))
    for u in set(us):
        big = max(u, 12 - u)
        want = min(1.0, 2 * sum(1 for v in us if v >= big) / len(us))
        assert tails.mwu_exact_two_sided(u, 3, 4) == pytest.approx(want)


def test_mann_whitney_tiny_sample_is_exact(spark):
    df = spark.createDataFrame([(float(v), v in (0, 5, 6)) for v in range(7)], "x double, a boolean")
    row = mann_whitney(df, "x", F.col("a")).first()
    assert row.u == 8.0 and row.p_value == pytest.approx(tails.mwu_exact_two_sided(8, 3, 4))


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 0.5]
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p double")
    order, run, want = sorted(range(len(ps)), key=lambda i: ps[i]), 0.0, {}
    for r, i in enumerate(order):
        run = max(run, min(1.0, (len(ps) - r) * ps[i]))
        want[i] = run
    got = {r.id: r.p_holm for r in holm(df, "p", ["id"]).collect()}
    assert got == pytest.approx(want)


def test_chi_square_counts_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 20 + [("a", "y")] * 5, "r string, c string")
    row = chi_square(df, "r", "c").first()
    table, n = {("a", "x"): 10, ("a", "y"): 5, ("b", "x"): 0, ("b", "y"): 20}, 35
    want = sum((o - r * c / n) ** 2 / (r * c / n) for (i, j), o in table.items() for r, c in [({"a": 15, "b": 20}[i], {"x": 10, "y": 25}[j])])
    assert row.chi2 == pytest.approx(want) and row.dof == 1 and row.cramers_v == pytest.approx(math.sqrt(want / n))


@given(s=st.integers(0, 50), extra=st.integers(0, 50), prior=st.floats(0, 1), m=st.floats(0.1, 100))
def test_shrinkage_bounds(s, extra, prior, m):
    n = s + extra
    value = (s + m * prior) / (n + m)
    raw = s / n if n else prior
    assert min(raw, prior) - 1e-12 <= value <= max(raw, prior) + 1e-12


def test_shrink_without_weight_is_the_prior(spark):
    assert one(spark, stats.shrink(F.lit(0), F.lit(0), 0.4, 0)) == 0.4


@pytest.mark.parametrize("n", [4 * 10**9, 10**12, 10**14])
def test_binomial_keeps_its_digits_at_large_n(n):
    k = int(n / 2 - math.sqrt(n) / 2)
    sd = math.sqrt(n) / 2
    assert tails.binom_two_sided(k, n) == pytest.approx(2 * tails.normal_sf((n / 2 - k - 0.5) / sd), abs=1e-7)


def test_unsettled_fraction_raises():
    with pytest.raises(ArithmeticError):
        tails._fraction(lambda i: ((1.0 if i % 2 else -1.0, 0.1),), 1)


def test_large_exact_mann_whitney_is_near_the_normal_or_raises():
    u, n1, n2 = 1_200_000, 8, 400_000
    z = (n1 * n2 / 2 - u) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert tails.mwu_exact_two_sided(u, n1, n2) == pytest.approx(2 * tails.normal_sf(abs(z)), abs=0.01)
    with pytest.raises(ValueError):
        tails.mwu_exact_two_sided(4e9, 8, 10**9)
