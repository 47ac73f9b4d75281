from random import Random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.operators import elo as E
from contestry.operators import learn as L
from contestry.operators import registry as RG
from contestry.operators import scoring as SC
from contestry.plans.experiment import Config, run_tier
from contestry.plans.summary import analytics_summary
from contestry.sources import contests as S


@pytest.fixture(scope="module")
def feats(spark, sf):
    return S.stored_rated_features(spark, sf)


def newton(x, y, c, rounds=50):
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(b)) / c, x.T @ (p - y) + b / c)
    return b


def test_logistic_matches_newton(feats):
    cols = ["elo_diff", "home_diff", "form10_diff"]
    rows = np.array([[r[c] for c in (*cols, "a_wins")] for r in feats.select(*cols, "a_wins").collect()])
    x, y = rows[:, :-1], rows[:, -1]
    m = L.fit(feats, "logreg", {"C": 0.1}, "pre_toss", columns=cols)
    want = newton(x / x.std(axis=0), y, 0.1) / x.std(axis=0)
    assert list(m.coefficients().values()) == pytest.approx(list(want), abs=1e-6)


def test_permutation_importance_sends_values_alone(feats):
    cols = ["elo_diff", "home_diff", "form10_diff"]
    m = L.fit(feats, "logreg", {"C": 0.1}, "pre_toss", columns=cols)
    few = feats.where("match_id % 3 = 0")
    result = L.permutation_importance(few, m, ["form10_diff", "elo_diff"], repeats=3, seed=7)
    assert "ShuffledHashJoin" in result._jdf.queryExecution().toString()
    rows = np.array([[r[c] for c in (*cols, "a_wins")] for r in few.orderBy("match_id").select(*cols, "a_wins").collect()], float)
    n, beta, draw = len(rows), np.array(list(m.coefficients().values())), Random(7)

    def loss(x):
        p = np.clip(1 / (1 + np.exp(-x @ beta)), 1e-12, 1 - 1e-12)
        return -(rows[:, -1] * np.log(p) + (1 - rows[:, -1]) * np.log(1 - p)).mean()

    want = {}
    for c in ("form10_diff", "elo_diff"):
        gains = []
        for _ in range(3):
            a, b = L._affine(n, draw)
            x = rows[:, :-1].copy()
            x[:, cols.index(c)] = rows[(a * np.arange(1, n + 1) + b) % n, cols.index(c)]
            gains.append(loss(x) - loss(rows[:, :-1]))
        want[c] = (np.mean(gains), np.std(gains))
    got = {r.feature: (r.importance, r["std"]) for r in result.collect()}
    assert set(got) == set(want)
    for c in want:
        assert got[c] == pytest.approx(want[c], abs=1e-9)


def test_batched_newton(feats):
    rows = feats.selectExpr("1 AS cand", "season_year", "a_wins AS y", "elo_diff / 100 AS x1", "home_diff AS x2")
    got = {r.fold: (r.b1, r.b2) for r in L.newton_logistic(rows, ["cand"], [1997, 1999]).collect()}
    data = np.array([[float(v) for v in r] for r in rows.select("season_year", "y", "x1", "x2").collect()])
    for fold, b in got.items():
        t = data[data[:, 0] < fold]
        assert b == pytest.approx(tuple(newton(t[:, 2:], t[:, 1], 1.0)), abs=1e-8)


@pytest.mark.parametrize("name, params", [("logreg", {"C": 0.1}), ("random_forest", {"min_leaf": 25, "max_features": 0.3, "trees": 5}), ("hist_gb", {"max_depth": 2, "learning_rate": 0.05, "iters": 3})])
def test_predictions_are_symmetric(feats, name, params):
    m = L.fit(feats.where("season_year < 1999"), name, params, "post_toss")
    gap = SC.swap_check(feats.where("season_year = 1999"), m, L.Calibrator("none")).agg(F.max("gap")).first()[0]
    assert gap < 1e-12


def test_calibrators(feats):
    df = feats.select("match_id", "season_year", "stage", F.col("a_wins").alias("y"), F.expr("1 / (1 + exp(-elo_diff / 50))").alias("p")).cache()
    for method in L.METHODS:
        c = L.fit_calibrator(df, method).symmetric(df, "p", "c").agg(F.min("c"), F.max("c")).first()
        assert 0 < c[0] <= c[1] < 1
    assert L.choose_method(L.time_ordered_calibration(df.where("season_year <= 1998"))) in L.METHODS


def test_contributions_add_up(feats):
    m = L.fit(feats, "logreg", {"C": 0.1}, "pre_toss")
    x = L.contributions(feats.limit(20), m.coefficients()).withColumn("z", m.logit())
    x = x.withColumn("total", F.expr("aggregate(drivers, 0D, (s, d) -> s + d.contribution)"))
    assert x.where("abs(z - total) > 1e-9").count() == 0
    r = x.withColumn("text", L.driver_sentence()).first()
    sizes = [abs(d.contribution) for d in r.drivers]
    assert sizes == sorted(sizes, reverse=True) and r.text.startswith("Largest effects: ")


def test_experiment(spark, feats, tmp_path):
    base = str(tmp_path)
    cfg = Config(
        S.FIRST_VALID, S.DEV_LAST, S.HOLDOUT, resamples=20, paired_resamples=20, families=("elo_logit", "logreg"),
        grids={"elo_logit": [{"C": 1.0}], "logreg": [{"C": 0.03}, {"C": 0.1}]}, importance_repeats=1,
    )
    r = run_tier(feats, "post_toss", cfg, base)
    assert r["chosen"] in ("elo_logit", "logreg") and r["metrics"].first().n == r["holdout"].count() > 100
    assert len(r["paired"]) == 5 and r["ablation"].count() == 6 and r["ci"].count() == 4
    assert r["oof"].where("c IS NULL").count() == 0 and r["importance"].count() > 0
    assert not r["guard"].first().suspicious
    assert r["ledger"].first().evaluations == 1
    model, cal, run_id = RG.load_active(spark, base, "post_toss")
    assert run_id == r["run_id"] and model.coefficients() == r["model"].coefficients()
    part = next(p for p in (tmp_path / "runs").rglob("part-*") if p.is_file())
    (part.parent / "part-99999").write_bytes(b"added later")
    with pytest.raises(ValueError, match="changed"):
        RG.load_active(spark, base, "post_toss")
    again = RG.log_holdout_access(spark, f"{base}/ledger", "post_toss", {"other": 1}).first()
    assert again.reused_with_new_selection and again.distinct_selections == 2


def test_shuffled_labels_carry_no_signal(feats):
    from contestry.functions.text import hash_unit
    from contestry.operators.evaluate import auc

    f = feats.withColumn("a_wins", (hash_unit(F.col("match_id").cast("string")) < 0.5).cast("double")).cache()
    m = L.fit(f.where("season_year <= 1998"), "logreg", {"C": 0.003}, "post_toss")
    a = auc(m.predict(f.where("season_year > 1998")), "a_wins", "p").first().auc
    assert 0.42 < a < 0.58


def test_summary_sections(tables, sf):
    s = analytics_summary(tables["matches"], tables["players"])
    pairs = duckdb.sql(f"SELECT sum(n // 2) FROM (SELECT count(DISTINCT l_suppkey) AS n FROM '{sf}/lineitem.parquet' GROUP BY l_orderkey)").fetchall()[0][0]
    assert len(s) > 20 and s["kpis"].first().matches == pairs


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 30, 1000])
def test_affine_permutations_are_permutations(n):
    draw = Random(3)
    for _ in range(20):
        a, b = L._affine(n, draw)
        assert sorted((a * i + b) % n for i in range(1, n + 1)) == list(range(n))


def test_rating_search_matches_single_solutions(spark, sf, tables):
    """Losses of a few settings out of one solution equal those of the settings solved one by one."""
    m = tables["matches"]
    params = [E.EloParams(k=32, home_bonus=0, season_regression=0.0, use_margin=False), E.EloParams(early_season_k_boost=0.5)]
    got = {r.cand: r.mean_log_loss for r in L.tune_ratings(m, params, S.FIRST_VALID, S.DEV_LAST).collect()}
    ratings, games = E.solve(m, params)
    want = {r.cand: r.mean_log_loss for r in L.score_candidates(L.rating_candidates(m, games, ratings), S.FIRST_VALID, S.DEV_LAST).collect()}
    assert got == pytest.approx(want, abs=1e-7) and len(got) == 2


def test_rating_search_keeps_no_number_a_contest_and_candidate(spark, tables, tmp_path, monkeypatch):
    """Groups of candidates and blocks of days of any size give equal losses; what is written does not grow with the candidates."""
    from contestry import session
    from contestry.operators import rating_search as RSE

    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    m, params = tables["matches"], E.candidates(E.ELO_GRID)[::8]
    folds = L.fold_seasons(m.where("is_decided"), S.FIRST_VALID, S.DEV_LAST)
    whole = RSE.search(m, params, folds)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 8 * m.count() * len(params)
    small = RSE.search(m, params, folds, width=7, block=100)
    assert whole.shape == (len(params), len(folds)) and small == pytest.approx(whole, abs=1e-12)


def test_folds_of_a_logistic_family_are_solved_together(feats, monkeypatch):
    """Every fold and setting equals the model fitted alone, and none is fitted alone."""
    cols = ["elo_diff", "home_diff", "form10_diff", "a_bats_first"]
    alone = {(s, c): list(L.fit(feats.where(F.col("season_year") < s), "logreg", {"C": c}, "post_toss", columns=cols).coefficients().values()) for s in (1996, 1998) for c in (0.003, 1.0)}
    got = L.fit_folds(feats, cols, list(alone))
    assert got == pytest.approx(np.array(list(alone.values())), abs=1e-6)
    monkeypatch.setattr(L, "LogisticRegression", None)
    oof = L.walk_forward(feats, "logreg", {"C": 1.0}, [1996, 1998], "post_toss", columns=cols)
    rows = oof.join(feats.select("match_id", *cols), "match_id").collect()
    assert {r.season_year for r in rows} == {1996, 1998} and len(rows) == feats.where("season_year IN (1996, 1998)").count()
    for r in rows:
        assert r.p == pytest.approx(1 / (1 + np.exp(-sum(b * r[c] for b, c in zip(alone[r.season_year, 1.0], cols, strict=True)))), abs=1e-6)
    with pytest.raises(Exception, match="met a null"):
        L.fit_folds(feats.withColumn("form10_diff", F.when(F.col("match_id") % 9 > 0, F.col("form10_diff"))), cols, [(1996, 1.0)])
