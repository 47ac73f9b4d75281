"""Isotonic fits against a brute-force one, as max over starts of min over ends of the means."""

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.operators import learn as L
from contestry.operators.isotonic import isotonic_pools, knots, pool


def brute(points):
    """{p: value} of (p, y) rows."""
    ps = sorted({p for p, _ in points})
    w = np.array([sum(1 for q, _ in points if q == p) for p in ps], float)
    s = np.array([sum(y for q, y in points if q == p) for p in ps], float)
    n = range(len(ps))
    return {ps[i]: max(min(s[a : b + 1].sum() / w[a : b + 1].sum() for b in n if b >= i) for a in n if a <= i) for i in n}


def rows(n, seed, distinct=40):
    r = Random(seed)
    out = []
    for _ in range(n):
        p = r.randrange(distinct) / distinct
        out.append((p, float(r.random() < 0.2 + 0.6 * p), r.randrange(5)))
    return out


@pytest.mark.parametrize("n", [1, 2, 50, 600])
def test_pools_equal_brute_force(spark, n):
    data = rows(n, n)
    df = spark.createDataFrame(data, "p double, y double, season_year long").repartition(7)
    # A hot forecast, nulls and NaN beside the rows.
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 0), (0.3, None, 0), (float("nan"), 1.0, 0)], df.schema))
    fits = [F.col("season_year") < s for s in (0, 2, 5)]
    got = isotonic_pools(df, fits).collect()
    assert not [r for r in got if r.fit == 0]
    for i, s in ((1, 2), (2, 5)):
        want = brute([(p, y) for p, y, t in data if t < s]) if any(t < s for _, _, t in data) else {}
        mine = [r for r in got if r.fit == i]
        assert sum(r.weight for r in mine) == sum(1 for _, _, t in data if t < s)
        assert len(mine) == len({round(v, 12) for v in want.values()})
        for p, v in want.items():
            (r,) = [r for r in mine if r.lo <= p <= r.hi]
            assert r.value == pytest.approx(v, abs=1e-12)


def test_pools_merge_in_any_cut():
    data = sorted(rows(300, 3, 300))
    p, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    one = np.ones(len(p))
    whole = pool(p, p, one, y)
    for cut in (1, 7, 150, 299):
        a, b = pool(p[:cut], p[:cut], one[:cut], y[:cut]), pool(p[cut:], p[cut:], one[cut:], y[cut:])
        merged = pool(*(np.concatenate(c) for c in zip(a, b)))
        assert all(np.allclose(u, v) for u, v in zip(whole, merged))


def test_empty_and_prefix_fits(spark):
    df = spark.createDataFrame(rows(400, 9), "p double, y double, season_year long")
    assert knots(isotonic_pools(df.limit(0), [F.lit(True)]), 1) == [[]]
    with pytest.raises(ValueError, match="needs a row"):
        L.fit_calibrator(df.limit(0), "isotonic")
    cals = L.prefix_calibrators(df, "isotonic", [2, 4])
    for s, c in cals.items():
        single = L.fit_calibrator(df.where(F.col("season_year") < s), "isotonic")
        assert c.knots == single.knots
        values = [r.c for r in c.transform(df, "p", "c").orderBy("p").collect()]
        assert values == sorted(values)
    n = df.where("season_year >= 4").count()
    assert L.calibrated_oof(df, "isotonic", 10).where("season_year >= 4 AND c BETWEEN 0 AND 1").count() == n
