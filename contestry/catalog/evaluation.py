"""Registered queries: evaluation of forecasts, resampling, folds, drift, closed-form statistics."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import functions as F

from contestry.catalog.base import POTM, SQUADS, binom_half_sql, div, out, q6, t_p_sql, wilson_sql, sql
from contestry.catalog.features import ELO, PF_CTES, PF_SQUAD, SQUAD, fsql
from contestry.functions import stats as ST
from contestry.functions import tails as TL
from contestry.operators import asof as A
from contestry.operators import evaluate as E
from contestry.operators.isotonic import isotonic_pools
from contestry.operators.ordering import exact_quantiles
from contestry.operators.records import count_if, count_rows, holm, rate_table
from contestry.sources import contests as S

Q, SQL = {}, {}
RESAMPLES, PAIRED = 2000, 10000


def query(name: str, text: str | None = None):
    def add(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


# Forecasts to evaluate: the venue's as-of batting-first rate, and a logistic curve in form.
PRED = """
pr AS (SELECT match_id, season_year, stage, a_wins AS y, is_decided,
         round(CASE WHEN a_bats_first > 0 THEN venue_bat_first_rate ELSE 1-venue_bat_first_rate END, 9) AS p,
         round(1/(1+pow(10.0e0, -form10_diff)), 9) AS p_ref FROM pf WHERE is_decided)"""
LL = "-(y*ln(greatest(1e-12, least(1-1e-12, {0})))+(1-y)*ln(1-greatest(1e-12, least(1-1e-12, {0}))))"


def forecasts(spark, sf):
    f = S.stored_features(spark, sf).where("is_decided")
    return f.selectExpr(
        "match_id", "season_year", "stage", "a_wins AS y",
        "round(CASE WHEN a_bats_first > 0 THEN venue_bat_first_rate ELSE 1 - venue_bat_first_rate END, 9) AS p",
        "round(1 / (1 + pow(10D, -form10_diff)), 9) AS p_ref",
    )


def psql(body: str, *ctes: str) -> str:
    return fsql(body, *PF_CTES, PRED, *ctes)


def _metrics(p: str = "p") -> str:
    return (
        f"count(*) AS n, {q6(f'avg({LL.format(p)})')} AS log_loss, {q6(f'avg(({p}-y)*({p}-y))')} AS brier, "
        f"{q6(f'(1-avg(({p}-y)*({p}-y))/0.25e0)')} AS brier_skill_vs_coin, "
        f"{q6(f'avg(CASE WHEN ({p}>=0.5)=(y=1) THEN 1.0e0 ELSE 0 END)')} AS accuracy, {q6(f'avg({p})')} AS mean_pred, {q6('avg(y*1.0e0)')} AS base_rate"
    )


@query("forecast_metrics", psql(f"SELECT {_metrics()} FROM pr"))
def forecast_metrics(spark, sf):
    return out(E.metrics(forecasts(spark, sf)))


@query("segment_metrics", psql(f"SELECT season_year, stage, {_metrics()} FROM pr GROUP BY season_year, stage"))
def segment_metrics(spark, sf):
    return out(E.metrics(forecasts(spark, sf), group=["season_year", "stage"]))


AUC = """
au AS (SELECT season_year, sum(pos*(nb+neg/2.0e0))/(sum(pos)*1.0e0*sum(neg)) AS auc FROM (
  SELECT season_year, p, pos, neg, sum(neg) OVER (PARTITION BY season_year ORDER BY p)-neg AS nb FROM (
    SELECT season_year, p, count(*) FILTER (y=1) AS pos, count(*) FILTER (y=0) AS neg FROM pr GROUP BY 1, 2)) GROUP BY 1)"""


@query("auc_by_season", psql(f"SELECT season_year, {q6('auc')} AS auc FROM au", AUC))
def auc_by_season(spark, sf):
    return out(E.auc(forecasts(spark, sf), group=["season_year"]))


BINS = """
bn AS (SELECT *, (row_number() OVER (ORDER BY p, match_id)-1)*10//count(*) OVER () AS bin FROM pr),
rl AS (SELECT bin, count(*) AS n, avg(p) AS mean_pred, avg(y*1.0e0) AS observed FROM bn GROUP BY bin)"""


@query(
    "reliability_table",
    psql(f"SELECT CAST(bin AS BIGINT) AS bin, n, {q6('mean_pred')} AS mean_pred, {q6('observed')} AS observed FROM rl", BINS),
)
def reliability_table(spark, sf):
    return out(E.reliability_table(forecasts(spark, sf), "match_id"))


@query(
    "calibration_summary",
    psql(
        f"""SELECT {q6('sum(n*abs(mean_pred-observed))/sum(n)')} AS ece, {q6('sum(n*(mean_pred-observed)*(mean_pred-observed))/sum(n)')} AS reliability,
        {q6('sum(n*(observed-b)*(observed-b))/sum(n)')} AS resolution, {q6('max(b*(1-b))')} AS uncertainty
        FROM rl CROSS JOIN (SELECT avg(y*1.0e0) AS b FROM pr)""",
        BINS,
    ),
)
def calibration_summary(spark, sf):
    return out(E.calibration_summary(E.reliability_table(forecasts(spark, sf), "match_id")))


@query(
    "too_good_check",
    psql(
        """SELECT season_year, CASE WHEN auc > 0.5 THEN printf('AUC %.3f > 0.5', auc) ELSE '' END AS reasons,
        CAST(auc > 0.5 AS BIGINT) AS suspicious FROM au""",
        AUC,
    ),
)
def too_good_check(spark, sf):
    df = forecasts(spark, sf)
    m = E.metrics(df, group=["season_year"]).join(E.auc(df, group=["season_year"]), "season_year")
    return out(E.too_good_check(m, max_auc=0.5, max_accuracy=1.0), "season_year", "reasons", "suspicious")


@query(
    "isotonic_calibration",
    psql(
        f"""SELECT season_year, lo, hi, weight, {q6('value')} AS value FROM (
          SELECT season_year, value, min(p) AS lo, max(p) AS hi, sum(w) AS weight FROM (
            SELECT season_year, p, any_value(w) AS w, max(low) AS value FROM (
              SELECT season_year, a, b AS p, w, min(mean) OVER (PARTITION BY season_year, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low
              FROM (SELECT season_year, x.p AS a, z.p AS b, z.w, (z.cs-x.cs+x.s)/(z.cw-x.cw+x.w) AS mean FROM ip x JOIN ip z USING (season_year) WHERE z.p >= x.p))
            GROUP BY season_year, p)
          GROUP BY season_year, value)""",
        f"""ip AS (SELECT season_year, p, w, s, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM (
              SELECT f.season_year, round(pr.p, 3) AS p, count(*)*1.0e0 AS w, sum(y)*1.0e0 AS s
              FROM pr JOIN (SELECT DISTINCT season_year FROM pr WHERE season_year BETWEEN {S.FIRST_VALID} AND {S.DEV_LAST}) f ON pr.season_year < f.season_year GROUP BY 1, 2)
            WINDOW o AS (PARTITION BY season_year ORDER BY p))""",
    ),
)
def isotonic_calibration(spark, sf):
    """Pools of the isotonic fit of every season on the seasons before it; forecasts to three digits."""
    f = forecasts(spark, sf)
    seasons = sorted(r[0] for r in f.where(F.col("season_year").between(S.FIRST_VALID, S.DEV_LAST)).select("season_year").distinct().collect())  # short list
    pools = isotonic_pools(f, [F.col("season_year") < s for s in seasons], digits=3)
    year = F.get(F.array(*map(F.lit, seasons)), F.col("fit"))
    return out(pools.select(year.alias("season_year"), "lo", "hi", "weight", "value"))


_T = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(13)]
_U = "(('0x' || substr(md5('42|' || b || '|' || match_id), 1, 8))::BIGINT/4294967296.0e0)"
WEIGHTS = f"""
wt AS NOT MATERIALIZED (SELECT * FROM (SELECT *, {'+'.join(f'CAST(u >= {t!r} AS INT)' for t in _T)} AS w
       FROM (SELECT match_id, y, p, p_ref, b, {_U} AS u FROM pr, range(0, {RESAMPLES}) AS t(b))) WHERE w > 0)"""


@query(
    "bootstrap_ci",
    psql(
        f"""SELECT metric, {q6('quantile_cont(v, 0.025)')} AS low, {q6('quantile_cont(v, 0.975)')} AS high FROM (
          UNPIVOT (SELECT s.*, auc FROM (SELECT b, sum(w*({LL.format('p')}))/sum(w) AS log_loss, sum(w*(p-y)*(p-y))/sum(w) AS brier,
                      sum(w*(CASE WHEN (p>=0.5)=(y=1) THEN 1.0e0 ELSE 0 END))/sum(w) AS accuracy FROM wt GROUP BY b) s
                   JOIN (SELECT b, sum(pos*(nb+neg/2.0e0))/(sum(pos)*1.0e0*sum(neg)) AS auc FROM (
                      SELECT b, p, pos, neg, sum(neg) OVER (PARTITION BY b ORDER BY p)-neg AS nb FROM (
                        SELECT b, p, sum(w*y) AS pos, sum(w*(1-y)) AS neg FROM wt GROUP BY 1, 2)) GROUP BY 1) a ON a.b = s.b)
          ON log_loss, brier, accuracy, auc INTO NAME metric VALUE v) GROUP BY metric""",
        WEIGHTS,
    ),
)
def bootstrap_ci(spark, sf):
    return out(E.bootstrap_ci(forecasts(spark, sf), "match_id", resamples=RESAMPLES))


@query(
    "paired_bootstrap",
    psql(
        f"""SELECT (SELECT {q6(f"avg(({LL.format('p')})-({LL.format('p_ref')}))")} FROM pr) AS diff, {q6('quantile_cont(v,0.025)')} AS ci_low,
        {q6('quantile_cont(v,0.975)')} AS ci_high, {q6('avg(CASE WHEN v>=0 THEN 1.0e0 ELSE 0 END)')} AS p_not_better
        FROM (SELECT b, sum(w*(({LL.format('p')})-({LL.format('p_ref')})))/sum(w) AS v FROM wt GROUP BY b)""",
        WEIGHTS.replace(f"range(0, {RESAMPLES})", f"range(0, {PAIRED})"),
    ),
)
def paired_bootstrap(spark, sf):
    return out(E.paired_bootstrap(forecasts(spark, sf), "match_id", "y", "p", "p_ref", PAIRED))


@query(
    "diebold_mariano",
    psql(
        f"""SELECT n, {q6('s')} AS dm_stat, {q6(t_p_sql('s', '(n-1.0e0)'))} AS p_value
        FROM (SELECT count(*) AS n, avg(d)/sqrt(var_pop(d)/count(*))*sqrt((count(*)-1.0e0)/count(*)) AS s
              FROM (SELECT ({LL.format('p')})-({LL.format('p_ref')}) AS d FROM pr))"""
    ),
)
def diebold_mariano(spark, sf):
    return out(E.diebold_mariano(forecasts(spark, sf), "y", "p", "p_ref"))


FOLDS = f"""
fd AS (SELECT f.season_year AS fold, s.season_year FROM (SELECT DISTINCT season_year FROM m) s
       JOIN (SELECT DISTINCT season_year FROM m WHERE season_year BETWEEN {S.FIRST_VALID} AND {S.DEV_LAST}) f ON s.season_year <= f.season_year)"""


@query(
    "walk_forward_folds",
    sql("SELECT fold, season_year, CASE WHEN season_year=fold THEN 'valid' ELSE 'train' END AS part FROM fd", FOLDS),
)
def walk_forward_folds(spark, sf):
    return out(E.folds(S.stored(spark, sf)["matches"], S.FIRST_VALID, S.DEV_LAST))


@query(
    "dev_holdout_split",
    fsql(
        f"SELECT CASE WHEN season_year <= {S.DEV_LAST} THEN 'dev' ELSE 'holdout' END AS part, count(*) AS n, sum(a_wins)::BIGINT AS wins"
        f" FROM pf WHERE is_decided AND (season_year <= {S.DEV_LAST} OR season_year IN {S.HOLDOUT}) GROUP BY 1",
        *PF_CTES,
    ),
)
def dev_holdout_split(spark, sf):
    dev, hold = E.split_dev_holdout(S.stored_features(spark, sf).where("is_decided"), S.DEV_LAST, S.HOLDOUT)
    both = dev.withColumn("part", F.lit("dev")).unionByName(hold.withColumn("part", F.lit("holdout")))
    return out(both.groupBy("part").agg(count_rows().alias("n"), F.sum("a_wins").cast("long").alias("wins")))


# Ratings of both sides before a contest, seen from side a.
RATED = """
el AS (SELECT m.match_id AS el_id, CASE WHEN flip THEN b.pre-a.pre ELSE a.pre-b.pre END AS elo_diff FROM m JOIN coin ON coin.match_id = m.match_id
       JOIN days ON days.day=m.day JOIN elo a ON a.league=m.league AND a.t=days.t AND a.team=team1 JOIN elo b ON b.league=m.league AND b.t=days.t AND b.team=team2)"""
_BASE = ("B0_constant", "B1_chase_prior", "B2_toss_winner", "B3_elo", "B4_venue_chase")
BASELINES = """
rt AS (SELECT fold, avg(CASE WHEN a_bats_first<0 THEN a_wins ELSE 1-a_wins END) AS ch, avg(CASE WHEN a_won_toss>0 THEN a_wins ELSE 1-a_wins END) AS ts
       FROM fd JOIN pf ON pf.season_year = fd.season_year WHERE fd.season_year < fold AND is_decided GROUP BY fold),
bl AS (SELECT pf.season_year AS fold, a_wins AS y, 0.5e0 AS B0_constant, CASE WHEN a_bats_first<0 THEN ch ELSE 1-ch END AS B1_chase_prior,
         CASE WHEN a_won_toss>0 THEN ts ELSE 1-ts END AS B2_toss_winner, 1/(1+pow(10.0e0, -(elo_diff+30*home_diff)/400.0e0)) AS B3_elo,
         CASE WHEN a_bats_first>0 THEN venue_bat_first_rate ELSE 1-venue_bat_first_rate END AS B4_venue_chase
       FROM pf JOIN rt ON rt.fold = pf.season_year JOIN el ON el_id = pf.match_id WHERE is_decided),
lo AS (""" + " UNION ALL ".join(
    f"SELECT '{b}' AS model, fold, count(*) AS n, avg({LL.format(b)}) AS log_loss FROM bl GROUP BY fold" for b in _BASE
) + ")"


def _baseline_losses(spark, sf):
    f = S.stored_rated_features(spark, sf).where("is_decided")
    fold_table = E.folds(f, S.FIRST_VALID, S.DEV_LAST)
    return E.fold_losses(E.baselines(f, fold_table), _BASE)


@query("baseline_fold_losses", fsql(f"SELECT model, fold, n, {q6('log_loss')} AS log_loss FROM lo", *PF_CTES, FOLDS, ELO, RATED, BASELINES))
def baseline_fold_losses(spark, sf):
    return out(_baseline_losses(spark, sf))


_CV = "cv AS (SELECT model, avg(log_loss) AS mean, stddev_samp(log_loss) AS std, stddev_samp(log_loss)/sqrt(count(*)) AS se FROM lo GROUP BY model)"


@query(
    "cross_validation_summary",
    fsql(f"SELECT model, {q6('mean')} AS mean, {q6('std')} AS std, {q6('se')} AS se FROM cv", *PF_CTES, FOLDS, ELO, RATED, BASELINES, _CV),
)
def cross_validation_summary(spark, sf):
    return out(E.cv_summary(_baseline_losses(spark, sf)))


@query(
    "one_standard_error_choice",
    fsql(
        f"""SELECT (SELECT model FROM cv WHERE mean <= b.mean+b.se ORDER BY model LIMIT 1) AS chosen, b.model AS best_by_mean,
        {q6('(b.mean+b.se)')} AS threshold FROM (SELECT * FROM cv ORDER BY mean LIMIT 1) b""",
        *PF_CTES, FOLDS, ELO, RATED, BASELINES, _CV,
    ),
)
def one_standard_error_choice(spark, sf):
    return out(E.select_one_se(E.cv_summary(_baseline_losses(spark, sf)), _BASE))


# -- drift ------------------------------------------------------------------------------------

_DRIFT = A.feature_names("post_toss")
_DIGITS = {"elo_diff": 4}  # ratings are solved to a tolerance


def _drift_sql() -> str:
    parts = []
    for c in _DRIFT:
        parts.append(f"SELECT '{c}' AS feature, season_year, round(CAST({c} AS DOUBLE), {_DIGITS.get(c, 9)}) AS v FROM ps JOIN el ON el_id = match_id WHERE is_decided")
    return " UNION ALL ".join(parts)


@query(
    "feature_drift",
    fsql(
        f"""SELECT feature, {q6('psi')} AS psi, CASE WHEN psi > 0.25 THEN 'alert' WHEN psi > 0.1 THEN 'warn' ELSE 'stable' END AS status FROM (
          SELECT feature, CASE WHEN max(k) = 1 THEN CASE WHEN sum(away) = 0 THEN 0.0e0 ELSE CAST('inf' AS DOUBLE) END ELSE sum((a-e)*ln(a/e)) END AS psi FROM (
            SELECT feature, bin, max(k) AS k, sum(away) AS away, greatest(1e-4, sum(r)*1.0e0/max(nr)) AS e, greatest(1e-4, sum(c)*1.0e0/max(nc)) AS a FROM (
              SELECT l.feature, len(list_filter(edges[2:len(edges)-1], lambda z: z <= v)) AS bin, len(edges) AS k, r, c, nr, nc,
                     CASE WHEN len(edges)=1 AND c=1 AND abs(v-edges[1]) > 1e-8+1e-5*abs(edges[1]) THEN 1 ELSE 0 END AS away
              FROM lv l JOIN ed ON ed.feature = l.feature JOIN tt ON tt.feature = l.feature) GROUP BY feature, bin) GROUP BY feature)""",
        *PF_CTES, POTM, SQUADS, SQUAD, PF_SQUAD, ELO, RATED,
        f"""lv AS (SELECT feature, v, CAST(season_year <= {S.DEV_LAST} AS INT) AS r, CAST(season_year = (SELECT max(season_year) FROM m WHERE is_decided) AS INT) AS c
              FROM ({_drift_sql()}) WHERE v IS NOT NULL),
        ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges FROM lv WHERE r=1 GROUP BY feature),
        tt AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM lv GROUP BY feature)""",
    ),
)
def feature_drift(spark, sf):
    f = S.stored_rated_features(spark, sf).where("is_decided").select("season_year", *[F.round(c, _DIGITS.get(c, 9)).alias(c) for c in _DRIFT])
    latest = f.agg(F.max("season_year")).scalar()
    f = f.withColumn("_latest", latest)
    return out(E.drift_report(f, _DRIFT, F.col("season_year") <= S.DEV_LAST, F.col("season_year") == F.col("_latest")))


# -- closed-form statistics over given aggregates ---------------------------------------------

_lo, _hi = wilson_sql("s", "n")
_PER_TEAM = "SELECT team, count(*) FILTER (winner=team) AS s, count(*) FILTER (is_decided) AS n FROM (SELECT unnest([team1, team2]) AS team, winner, is_decided FROM m) GROUP BY team"


def _per_team(spark, sf):
    """Decided contests of every side, listed first or second, and those it won."""
    m = S.matches(spark, sf, stages=False).select(F.explode(F.array("team1", "team2")).alias("team"), "winner", "is_decided")
    return m.groupBy("team").agg(count_if(F.col("winner") == F.col("team")).alias("s"), count_if(F.col("is_decided")).alias("n"))


@query(
    "binomial_tests_by_side",
    sql(
        f"""SELECT team, s, n, {q6(div('s', 'n'))} AS rate, {q6(_lo)} AS ci_low, {q6(_hi)} AS ci_high, {q6(binom_half_sql('s', 'n'))} AS p_value,
        {q6('(s+10*0.5e0)/(n+10)')} AS shrunk FROM ({_PER_TEAM})"""
    ),
)
def binomial_tests_by_side(spark, sf):
    g = _per_team(spark, sf)
    low, high = ST.wilson(F.col("s"), F.col("n"))
    return out(
        g.select(
            "team", "s", "n", ST.ratio(F.col("s"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"),
            TL.binom_two_sided_p(F.col("s"), F.col("n"), F.lit(0.5)).alias("p_value"),
            ST.shrink(F.col("s"), F.col("n"), 0.5, 10).alias("shrunk"),
        )
    )


@query(
    "holm_adjusted_sides",
    sql(
        f"""SELECT team, {q6('p')} AS p_value, {q6('max(least(1.0e0, (cnt-rk+1)*p)) OVER (ORDER BY p, team ROWS UNBOUNDED PRECEDING)')} AS p_holm
        FROM (SELECT *, row_number() OVER (ORDER BY p, team) AS rk, count(*) OVER () AS cnt
              FROM (SELECT team, {binom_half_sql('s', 'n')} AS p FROM ({_PER_TEAM}) WHERE n > 0))"""
    ),
)
def holm_adjusted_sides(spark, sf):
    g = _per_team(spark, sf).where("n > 0")
    t = g.select("team", TL.binom_two_sided_p(F.col("s"), F.col("n"), F.lit(0.5)).alias("p_value"))
    return out(holm(t, "p_value", ["team"]))


@query(
    "exact_price_quantiles",
    "SELECT l_returnflag, CAST(q AS DOUBLE) AS q, "
    + q6("list_extract(qs, CAST(q*10 AS INT)+1)")
    + " AS quantile FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS qs FROM lineitem GROUP BY 1),"
    " (SELECT unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q)",
)
def exact_price_quantiles(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return out(exact_quantiles(li, "l_extendedprice", [i / 10 for i in range(11)], ["l_returnflag"]))


@query("tail_probabilities")
def tail_probabilities(spark, sf):
    """Normal, t, χ² and exact binomial tails and the normal quantile of per-side aggregates."""
    g = _per_team(spark, sf).where("n > 1")
    z = (F.col("s") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)
    x = g.select("team", "s", "n", z.alias("z"))
    return out(
        x.select(
            "team", "z", TL.normal_two_sided_p("z").alias("normal_p"),
            TL.t_two_sided_p("z", (F.col("n") - 1).cast("double")).alias("t_p"),
            TL.chi2_p(F.col("z") * F.col("z"), F.lit(1.0)).alias("chi2_p"),
            TL.normal_quantile((F.col("s") + 0.5) / (F.col("n") + 1)).alias("normal_q"),
            TL.binom_two_sided_p("s", "n", F.lit(0.45)).alias("binom_p45"),
        )
    )
