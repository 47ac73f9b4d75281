"""One tier from features to a serving model: select, calibrate, evaluate once on the holdout, refit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.operators import evaluate as EV
from contestry.operators import learn as L
from contestry.operators import registry as RG
from contestry.operators.asof import feature_names, guard_inputs
from contestry.session import Stage


@dataclass
class Config:
    first_valid: int
    dev_last: int
    holdout: tuple[int, ...]
    seed: int = 42
    resamples: int = 2000
    paired_resamples: int = 10000
    families: tuple[str, ...] = L.COMPLEXITY
    grids: dict | None = None
    home_bonus: float = 30.0
    importance_repeats: int = 10


def run_tier(features: DataFrame, tier: str, cfg: Config, base: str) -> dict:
    """Returns a dict of result tables plus the chosen names and the registered run id.

    ``features`` are the decided rows with all columns of the tier. Out-of-fold tables are written,
    so calibration and comparison read them instead of fitting again.
    """
    spark = features.sparkSession
    stage = Stage(spark, f"experiment-{tier}")
    cols = [c for c in feature_names(tier) if c in features.columns]
    guard_inputs(cols, tier)
    extra = [c for c in ("match_id", "season_year", "stage", "a_wins", "impact_era") if c not in cols]
    # Selected once, from the allow-listed columns only.
    f = stage.write(features.select(*extra, *cols), "features")
    dev, hold = EV.split_dev_holdout(f, cfg.dev_last, cfg.holdout)
    dev = dev.cache()
    seasons = L.fold_seasons(dev, cfg.first_valid, cfg.dev_last)
    grids = cfg.grids or {n: L.grid(n) for n in L.GRIDS}

    oof, losses = {}, None
    best: dict[str, dict] = {}

    def keep(name: str, params: dict, i: int, rows) -> None:
        nonlocal losses
        oof[(name, i)] = (params, rows)
        losses = L.oof_losses(rows) if losses is None else losses.unionByName(L.oof_losses(rows))

    for name in cfg.families:
        if name == "blend":
            continue
        if name in L.ENSEMBLES:  # all settings grow together
            rows = stage.write(L.walk_forward_ensembles(dev, name, grids[name], seasons, tier, cfg.seed), f"oof-{name}")
            for i, params in enumerate(grids[name]):
                keep(name, params, i, rows.where(F.col("params") == L.label(params)))
            continue
        for i, params in enumerate(grids[name]):
            keep(name, params, i, stage.write(L.walk_forward(dev, name, params, seasons, tier, cfg.seed), f"oof-{name}-{i}"))

    def choose_best() -> None:
        rows = EV.cv_summary(losses, ("model", "params")).collect()  # one row per configuration
        for r in rows:
            if r.model not in best or r["mean"] < best[r.model]["mean"]:
                key = next(k for k, (p, _) in oof.items() if k[0] == r.model and str(sorted(p.items())) == r.params)
                best[r.model] = {"mean": r["mean"], "std": r["std"], "se": r["se"], "key": key, "params": oof[key][0]}

    choose_best()
    if "blend" in cfg.families and {"logreg", "hist_gb"} <= set(best):
        sides = [oof[best[n]["key"]][1] for n in ("logreg", "hist_gb")]
        for i, w in enumerate(L.BLEND_WEIGHTS):
            params = {**best["hist_gb"]["params"], **best["logreg"]["params"], "weight": w}
            keep("blend", params, i, stage.write(L.blended(*sides, params), f"oof-blend-{i}"))
        choose_best()
    summary = spark.createDataFrame([(n, b["mean"], b["std"], b["se"]) for n, b in best.items()], ["model", "mean", "std", "se"])
    choice = EV.select_one_se(summary, L.COMPLEXITY)
    chosen = choice.first().chosen
    params, chosen_oof = oof[best[chosen]["key"]]

    comparison = stage.write(L.time_ordered_calibration(chosen_oof), "calibration")
    method = L.choose_method(comparison)
    ledger = RG.log_holdout_access(
        spark, f"{base}/ledger", tier, {"tier": tier, "model": chosen, "params": params, "calibration": method, "features": cols}
    )

    final = L.fit(dev, chosen, params, tier, cfg.seed)
    cal = L.fit_calibrator(chosen_oof, method)
    scored = cal.symmetric(final.predict(hold, "p_raw"), "p_raw", "p_model")
    scored = stage.write(EV.holdout_baselines(dev, scored, cfg.home_bonus), "holdout")
    metrics = EV.metric_suite(scored, "match_id", "a_wins", "p_model")
    refs = [c for c in scored.columns if c.startswith("p_B")]
    out = {
        "summary": summary, "losses": losses, "choice": choice, "calibration": comparison, "ledger": ledger,
        "holdout": scored, "metrics": metrics, "guard": EV.too_good_check(metrics),
        "ci": EV.bootstrap_ci(scored, "match_id", "a_wins", "p_model", cfg.resamples, cfg.seed),
        "paired": {r: EV.paired_bootstrap(scored, "match_id", "a_wins", "p_model", r, cfg.paired_resamples, cfg.seed) for r in refs},
        "diebold_mariano": {r: EV.diebold_mariano(scored, "a_wins", "p_model", r) for r in refs},
        "segments": EV.metrics(scored, "a_wins", "p_model", ["season_year", "stage"]),
        "oof": L.calibrated_oof(chosen_oof, method),
    }
    if "logreg" in best:
        out["ablation"] = L.ablation(dev, seasons, tier, best["logreg"]["params"]["C"], cfg.seed)
    early, late = dev.where(F.col("season_year") <= cfg.dev_last - 3), dev.where(F.col("season_year") > cfg.dev_last - 3)
    if early.take(1):
        probe = L.fit(early, chosen, params, tier, cfg.seed)
        out["importance"] = L.permutation_importance(late, probe, probe.columns, cfg.importance_repeats, cfg.seed)

    # Serving: the same frozen configuration on all decided rows.
    serve = L.fit(f, chosen, params, tier, cfg.seed)
    pairs = chosen_oof.select("y", "p").unionByName(scored.select(F.col("a_wins").alias("y"), F.col("p_raw").alias("p")))
    through = f.agg(F.max("season_year")).first()[0]
    out["run_id"] = RG.register(spark, base, tier, serve, L.fit_calibrator(pairs, method), through)
    out.update(chosen=chosen, params=params, method=method, model=serve)
    return out
