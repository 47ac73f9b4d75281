"""Registered queries: records, toss, venues, trends, people, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.catalog.base import (
    LONG, POTM, SQUADS, binom_half_sql, div, normal_p_sql, out, q6, sql, t_p_sql, wilson_sql,
)
from contestry.functions.stats import Z_975
from contestry.operators import records as R
from contestry.operators import trends as T
from contestry.operators.validate import CONSTANTS
from contestry.sources import contests as S
from contestry.sources import rawtext as RT
from statistics import NormalDist

Q, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


def _w(s: str, n: str) -> str:
    lo, hi = wilson_sql(s, n)
    return f"{q6(div(s, n))} AS rate, {q6(lo)} AS ci_low, {q6(hi)} AS ci_high"


MDE_K = repr(Z_975 + NormalDist().inv_cdf(0.8)) + "e0"


def _binomial(s: str, n: str) -> str:
    return (
        f"{_w(s, n)}, {q6(f'({div(s, n)} - 0.5e0)')} AS effect, {q6(f'{MDE_K}*sqrt(0.25e0/{n})')} AS mde, "
        f"{q6(binom_half_sql(s, n))} AS p_value"
    )


@query(
    "contest_view",
    sql(
        "SELECT match_id, strftime(date,'%Y-%m-%d') AS date, season_year, league, venue_id, venue, team1, team2, team1_runs,"
        " team2_runs, toss_winner, toss_decision, result_type, CAST(team1_home AS BIGINT) AS team1_home,"
        " CAST(team2_home AS BIGINT) AS team2_home FROM m"
    ),
)
def contest_view(spark, sf):
    return out(
        S.base_contests(spark, sf), "match_id", "date", "season_year", "league", "venue_id", "venue", "team1", "team2",
        "team1_runs", "team2_runs", "toss_winner", "toss_decision", "result_type", "team1_home", "team2_home",
    )


@query(
    "line_coverage",
    sql(
        """SELECT (SELECT count(*) FROM lineitem) AS lines_given, CAST(sum(CASE WHEN side_no <= 2 * pairs THEN n_lines ELSE 0 END) AS BIGINT) AS lines_used,
        (SELECT count(*) FROM m) AS contests
        FROM r JOIN (SELECT l_orderkey AS k, max(side_no) // 2 AS pairs FROM r GROUP BY 1) ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey"""
    ),
)
def line_coverage(spark, sf):
    return out(S.line_coverage(spark, sf))


_CANON = [
    "match_id", "winner", "bat_first", "chasing_team", "margin_type", "margin_value", "first_innings_runs",
    "second_innings_runs", "super_over_winner", "stage", "season_champion",
]
_CANON_FLAGS = [
    "is_decided", "bat_first_won", "toss_winner_won", "team1_bats_first", "voided", "scores_usable", "dls_heuristic",
    "dls_external", "dls_flag", "is_playoff", "is_final", "impact_era",
]


@query(
    "canonical_matches",
    sql(f"SELECT {', '.join(_CANON)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _CANON_FLAGS)} FROM m"),
)
def canonical_matches(spark, sf):
    return out(S.matches(spark, sf), *_CANON, *_CANON_FLAGS)


@query(
    "team_long",
    sql(
        "SELECT match_id, season_year, venue_id, stage, team, opponent, CAST(is_home AS BIGINT) AS is_home,"
        " CAST(opp_home AS BIGINT) AS opp_home, CAST(bats_first AS BIGINT) AS bats_first, CAST(won AS BIGINT) AS won,"
        " CAST(is_decided AS BIGINT) AS is_decided, CAST(voided AS BIGINT) AS voided, runs_for, runs_against FROM long",
        LONG,
    ),
)
def team_long(spark, sf):
    return out(
        R.team_long(S.matches(spark, sf)), "match_id", "season_year", "venue_id", "stage", "team", "opponent", "is_home",
        "opp_home", "bats_first", "won", "is_decided", "voided", "runs_for", "runs_against",
    )


_SEASONS = """
sw AS (SELECT season_year, team, count(*) AS matches, count(*) FILTER (is_decided) AS decided,
              count(*) FILTER (won) AS wins FROM long WHERE NOT voided GROUP BY 1, 2)"""
_lo, _hi = wilson_sql("t.wins", "(t.wins+t.losses)")


@query(
    "team_table",
    sql(
        f"""SELECT t.team, seasons, matches, wins, losses, matches-wins-losses AS no_decision,
        {q6(div('t.wins', 't.wins+t.losses'))} AS win_pct, {q6(_lo)} AS ci_low, {q6(_hi)} AS ci_high,
        coalesce(titles,0) AS titles, coalesce(finals,0) AS finals, best.season_year AS best_season, worst.season_year AS worst_season
        FROM (SELECT team, count(DISTINCT season_year) AS seasons, count(*) AS matches, count(*) FILTER (won) AS wins,
                     count(*) FILTER (NOT won) AS losses FROM long WHERE NOT voided GROUP BY team) t
        LEFT JOIN (SELECT team, count(*) AS finals, count(*) FILTER (won) AS titles FROM long WHERE stage='final' GROUP BY team) f
               ON f.team = t.team
        LEFT JOIN (SELECT team, season_year, row_number() OVER (PARTITION BY team ORDER BY wins*1.0e0/decided DESC, season_year) AS k
                   FROM sw WHERE decided >= 5) best ON best.team = t.team AND best.k = 1
        LEFT JOIN (SELECT team, season_year, row_number() OVER (PARTITION BY team ORDER BY wins*1.0e0/decided, season_year) AS k
                   FROM sw WHERE decided >= 5) worst ON worst.team = t.team AND worst.k = 1""",
        LONG, _SEASONS,
    ),
)
def team_table(spark, sf):
    return out(R.team_table(S.matches(spark, sf)))


@query(
    "season_win_pct",
    sql(f"SELECT season_year, team, matches, decided, wins, {q6(div('wins', 'decided'))} AS win_pct FROM sw", LONG, _SEASONS),
)
def season_win_pct(spark, sf):
    return out(R.season_win_pct(S.matches(spark, sf, stages=False)))


_H2H = "h2h AS (SELECT team, opponent, count(*) AS meetings, count(*) FILTER (won) AS wins FROM long WHERE is_decided GROUP BY 1, 2)"


@query("head_to_head", sql(f"SELECT team, opponent, meetings, wins, {q6(div('wins', 'meetings'))} AS win_pct FROM h2h", LONG, _H2H))
def head_to_head(spark, sf):
    return out(R.head_to_head(S.matches(spark, sf, stages=False)))


@query(
    "head_to_head_matrix",
    sql(f"SELECT team, opponent, {q6('(CASE WHEN meetings >= 2 THEN wins*1.0e0/meetings END)')} AS win_pct FROM h2h", LONG, _H2H),
)
def head_to_head_matrix(spark, sf):
    """Every cell of the matrix, a row for each ordered pair that met."""
    return out(R.head_to_head_cells(S.matches(spark, sf, stages=False), min_meetings=2))


_HOME = "home AS (SELECT *, CASE WHEN team1_home THEN winner=team1 ELSE winner=team2 END AS hw FROM m WHERE is_decided AND team1_home <> team2_home)"


@query(
    "home_advantage",
    sql(f"SELECT s AS successes, n, {_binomial('s', 'n')} FROM (SELECT count(*) FILTER (hw) AS s, count(*) AS n FROM home)", _HOME),
)
def home_advantage(spark, sf):
    return out(R.home_advantage(S.matches(spark, sf, stages=False))["overall"])


@query(
    "home_advantage_by_season",
    sql(f"SELECT season_year, {q6('avg(CAST(hw AS BIGINT))')} AS home_win_rate, count(*) AS n FROM home GROUP BY season_year", _HOME),
)
def home_advantage_by_season(spark, sf):
    return out(R.home_advantage(S.matches(spark, sf, stages=False))["by_season"])


def _rate(by: str, flag: str, where: str = "TRUE", name: str | None = None) -> str:
    return (
        f"SELECT {name or by}, s AS successes, n, {_w('s', 'n')} FROM (SELECT {by}{' AS ' + name if name else ''}, "
        f"count(*) FILTER ({flag}) AS s, count(*) AS n FROM m WHERE {where} GROUP BY 1)"
    )


@query(
    "toss_effect",
    sql(f"SELECT s AS successes, n, {_binomial('s', 'n')} FROM (SELECT count(*) FILTER (toss_winner_won) AS s, count(*) AS n FROM m WHERE is_decided)"),
)
def toss_effect(spark, sf):
    return out(R.toss_effect(S.matches(spark, sf, stages=False))["overall"])


@query("toss_by_decision", sql(_rate("toss_decision", "toss_winner_won", "is_decided")))
def toss_by_decision(spark, sf):
    return out(R.toss_effect(S.matches(spark, sf, stages=False))["by_decision"])


@query("toss_by_era", sql(_rate("CASE WHEN impact_era THEN 'new' ELSE 'old' END", "toss_winner_won", "is_decided", "era")))
def toss_by_era(spark, sf):
    return out(R.toss_effect(S.matches(spark, sf, stages=False))["by_era"])


def _era_sql(flag: str) -> str:
    return f"""SELECT n_a, n_b, {q6('pa')} AS rate_a, {q6('pb')} AS rate_b, {q6('(pa-pb)')} AS diff,
      {q6('(pa-pb-1.96e0*se)')} AS ci_low, {q6('(pa-pb+1.96e0*se)')} AS ci_high, {q6('z')} AS z, {q6(normal_p_sql('z'))} AS p_value
    FROM (SELECT *, sqrt(pa*(1-pa)/n_a+pb*(1-pb)/n_b) AS se,
            CASE WHEN pool*(1-pool) > 0 THEN (pa-pb)/sqrt(pool*(1-pool)*(1.0e0/n_a+1.0e0/n_b)) ELSE 0 END AS z
          FROM (SELECT *, s_a*1.0e0/n_a AS pa, s_b*1.0e0/n_b AS pb, (s_a+s_b)*1.0e0/(n_a+n_b) AS pool
                FROM (SELECT count(*) FILTER (impact_era AND {flag}) AS s_a, count(*) FILTER (impact_era) AS n_a,
                             count(*) FILTER (NOT impact_era AND {flag}) AS s_b, count(*) FILTER (NOT impact_era) AS n_b
                      FROM m WHERE is_decided)))"""


@query("toss_era_test", sql(_era_sql("toss_winner_won")))
def toss_era_test(spark, sf):
    return out(R.toss_effect(S.matches(spark, sf, stages=False))["era_test"])


def _chi2_sql(rows: str, cols: str, where: str) -> str:
    """Sum over every cell, the empty ones included."""
    return f"""WITH_PLACEHOLDER
      SELECT n, {q6('chi2')} AS chi2, dof, {q6('sqrt(chi2/(n*least(nr-1,nc-1)))')} AS cramers_v
      FROM (SELECT sum(o) AS n, sum((o-r*c/tot)*(o-r*c/tot)/(r*c/tot)) AS chi2, count(DISTINCT rk) AS nr, count(DISTINCT ck) AS nc,
                   (count(DISTINCT rk)-1)*(count(DISTINCT ck)-1) AS dof
            FROM (SELECT rk, ck, coalesce(o,0) AS o, r, c, (SELECT count(*)*1.0e0 FROM m WHERE {where}) AS tot
                  FROM (SELECT {rows} AS rk, count(*) AS r FROM m WHERE {where} GROUP BY 1)
                  CROSS JOIN (SELECT {cols} AS ck, count(*) AS c FROM m WHERE {where} GROUP BY 1)
                  LEFT JOIN (SELECT {rows} AS rk2, {cols} AS ck2, count(*) AS o FROM m WHERE {where} GROUP BY 1, 2)
                         ON rk = rk2 AND ck = ck2))""".replace("WITH_PLACEHOLDER", "")


@query(
    "toss_decision_outcome",
    sql(
        f"SELECT *, {q6(normal_p_sql('sqrt(chi2)'))} AS p_value FROM ("
        + _chi2_sql("toss_decision", "toss_winner_won", "is_decided").replace("AS n,", "AS n,", 1)
        + ")"
    ),
)
def toss_decision_outcome(spark, sf):
    return out(R.toss_effect(S.matches(spark, sf, stages=False))["decision_outcome"])


@query("venue_outcome_chi_square", sql(_chi2_sql("venue_id", "result_type", "TRUE")))
def venue_outcome_chi_square(spark, sf):
    return out(R.chi_square(S.matches(spark, sf, stages=False), "venue_id", "result_type").drop("p_value"))


@query(
    "chasing_advantage",
    sql(f"SELECT s AS successes, n, {_binomial('s', 'n')} FROM (SELECT count(*) FILTER (NOT bat_first_won) AS s, count(*) AS n FROM m WHERE is_decided)"),
)
def chasing_advantage(spark, sf):
    return out(R.chasing_advantage(S.matches(spark, sf, stages=False))["overall"])


@query("chasing_by_season", sql(_rate("season_year", "NOT bat_first_won", "is_decided")))
def chasing_by_season(spark, sf):
    return out(R.chasing_advantage(S.matches(spark, sf, stages=False))["by_season"])


@query("chasing_era_test", sql(_era_sql("NOT bat_first_won")))
def chasing_era_test(spark, sf):
    return out(R.chasing_advantage(S.matches(spark, sf, stages=False))["era_test"])


@query("field_first_share", sql(_rate("season_year", "toss_decision='field'")))
def field_first_share(spark, sf):
    return out(R.field_first_share(S.matches(spark, sf, stages=False)))


@query(
    "toss_by_venue",
    sql(
        f"""SELECT venue_id, n, {_w('s', 'n')}, {q6('p')} AS p_value,
        {q6('max(least(1.0e0, (cnt-rk+1)*p)) OVER (ORDER BY p, venue_id ROWS UNBOUNDED PRECEDING)')} AS p_holm
        FROM (SELECT *, row_number() OVER (ORDER BY p, venue_id) AS rk, count(*) OVER () AS cnt FROM (
              SELECT *, {binom_half_sql('s', 'n')} AS p FROM (SELECT venue_id, count(*) FILTER (toss_winner_won) AS s, count(*) AS n
              FROM m WHERE is_decided GROUP BY venue_id HAVING count(*) >= 20)))"""
    ),
)
def toss_by_venue(spark, sf):
    return out(R.toss_by_venue(S.matches(spark, sf, stages=False)))


@query(
    "venue_profiles",
    sql(
        f"""SELECT venue_id, venue, matches, decided, first_season, last_season, {q6('avg_r')} AS avg_first_innings,
        {q6('(runs+10*gm)/(n_runs+10)')} AS avg_first_innings_shrunk, {q6(div('bf', 'decided'))} AS bat_first_win_rate,
        {q6('(bf+10*gb)/(decided+10)')} AS bat_first_win_rate_shrunk, {q6('1-(bf+10*gb)/(decided+10)')} AS chase_win_rate_shrunk,
        {q6('fs')} AS field_share
        FROM (SELECT venue_id, min(venue) AS venue, count(*) AS matches, count(*) FILTER (is_decided) AS decided, min(season_year) AS first_season,
               max(season_year) AS last_season, avg(first_innings_runs) FILTER (scores_usable) AS avg_r,
               coalesce(sum(first_innings_runs) FILTER (scores_usable),0) AS runs, count(*) FILTER (scores_usable) AS n_runs,
               count(*) FILTER (bat_first_won) AS bf, avg(CASE WHEN toss_decision='field' THEN 1.0e0 ELSE 0 END) AS fs FROM m GROUP BY venue_id)
        CROSS JOIN (SELECT avg(first_innings_runs) FILTER (scores_usable) AS gm, avg(CAST(bat_first_won AS BIGINT)) AS gb FROM m)"""
    ),
)
def venue_profiles(spark, sf):
    return out(R.venue_profiles(S.matches(spark, sf, stages=False)))


@query(
    "kpis",
    sql(
        """SELECT count(*) AS matches, count(*) FILTER (is_decided) AS decided, strftime(min(date),'%Y-%m-%d') AS first_date,
        strftime(max(date),'%Y-%m-%d') AS last_date,
        (SELECT winner FROM m WHERE is_final ORDER BY date DESC, match_id DESC LIMIT 1) AS champion,
        (SELECT count(DISTINCT team) FROM long) AS sides, count(DISTINCT venue_id) AS places FROM m""",
        LONG,
    ),
)
def kpis(spark, sf):
    return out(R.kpis(S.matches(spark, sf)))


@query(
    "active_sides",
    sql("SELECT DISTINCT team FROM long WHERE season_year = (SELECT max(season_year) FROM m)", LONG),
)
def active_sides(spark, sf):
    return out(R.active_sides(S.matches(spark, sf, stages=False)))


@query(
    "filtered_explorer",
    sql(
        """SELECT match_id, strftime(date,'%d %b %Y') AS date, season_year, stage, a.s_name AS team1, b.s_name AS team2, venue, venue || ' City' AS city,
        CASE toss_winner WHEN m.team1 THEN a.s_name ELSE b.s_name END AS toss_winner, toss_decision, CASE bat_first WHEN m.team1 THEN a.s_name ELSE b.s_name END AS bat_first,
        first_innings_runs, second_innings_runs, w.s_name AS winner, result_type, margin_type, margin_value, CAST(dls_flag AS BIGINT) AS dls_flag, best.player AS player_of_match
        FROM m JOIN supplier a ON a.s_suppkey=m.team1 JOIN supplier b ON b.s_suppkey=m.team2 LEFT JOIN supplier w ON w.s_suppkey=m.winner LEFT JOIN best USING (match_id)
        WHERE season_year BETWEEN 1996 AND 1999 AND (m.team1=3 OR m.team2=3)""",
        POTM,
    ),
)
def filtered_explorer(spark, sf):
    """All columns of the explorer for the contests of one side over four seasons."""
    k = RT.knowledge(spark, sf)
    m = R.filter_matches(S.matches(spark, sf), season_from=1996, season_to=1999, team=3)
    return out(R.explorer(m.join(k.venues.select("venue_id", "city"), "venue_id"), k.teams, ["match_id"]))


@query(
    "filtered_playoff_record",
    sql("SELECT team, count(*) AS matches, count(*) FILTER (won) AS wins FROM long WHERE stage <> 'league' AND season_year >= 1997 GROUP BY team", LONG),
)
def filtered_playoff_record(spark, sf):
    m = R.filter_matches(S.matches(spark, sf), season_from=1997, stage="playoff")
    return out(R.team_long(m).groupBy("team").agg(R.count_rows().alias("matches"), R.count_if(F.col("won")).alias("wins")))


# -- trends -----------------------------------------------------------------------------------


@query(
    "scoring_by_season",
    sql(
        f"""SELECT season_year, count(*) AS matches, {q6('avg(first_innings_runs)')} AS mean_first_innings,
        {q6('quantile_cont(first_innings_runs, 0.5)')} AS median_first_innings,
        {q6('avg(CASE WHEN first_innings_runs >= 200 THEN 1.0e0 ELSE 0 END)')} AS share_200_plus,
        {q6('max(first_innings_runs)')} AS max_first_innings FROM m WHERE scores_usable GROUP BY season_year"""
    ),
)
def scoring_by_season(spark, sf):
    return out(T.scoring_by_season(S.matches(spark, sf, stages=False)))


_SCORED = "sc AS (SELECT first_innings_runs AS x, impact_era AS e FROM m WHERE scores_usable)"
_RANKS = """rk AS (SELECT x, n, a, sum(n) OVER (ORDER BY x) - n + (n+1)/2.0e0 AS ar
  FROM (SELECT x, count(*) AS n, count(*) FILTER (e) AS a FROM sc GROUP BY x)),
mw AS (SELECT u, (greatest(u, na*nb-u) - na*nb/2 - 0.5e0)/sqrt(na*nb/12*((n+1)-ties/(n*(n-1)))) AS z, na, nb
  FROM (SELECT sum(a*ar)-sum(a)*(sum(a)+1)/2.0e0 AS u, sum(a)*1.0e0 AS na, sum(n-a)*1.0e0 AS nb, sum(n)*1.0e0 AS n,
               sum(n*1.0e0*n*n-n) AS ties FROM rk))"""


@query(
    "era_scoring_test",
    sql(
        f"""SELECT n_pre, n_post, {q6('mean_pre')} AS mean_pre, {q6('mean_post')} AS mean_post, {q6('d')} AS diff,
        {q6('(d-1.96e0*se)')} AS ci_low, {q6('(d+1.96e0*se)')} AS ci_high, {q6('(d/sqrt((v_post+v_pre)/2))')} AS cohens_d,
        {q6('(d/se)')} AS welch_t, {q6('dof')} AS welch_dof, {q6('s_pre')} AS share_200_pre, {q6('s_post')} AS share_200_post,
        {q6(t_p_sql('(d/se)', 'dof'))} AS welch_p, (SELECT {q6('CASE WHEN z<=0 THEN 1.0e0 ELSE ' + normal_p_sql('z') + ' END')} FROM mw) AS mannwhitney_p
        FROM (SELECT *, mean_post-mean_pre AS d, sqrt(v_post/n_post+v_pre/n_pre) AS se,
                pow(v_post/n_post+v_pre/n_pre,2)/(pow(v_post/n_post,2)/(n_post-1)+pow(v_pre/n_pre,2)/(n_pre-1)) AS dof
              FROM (SELECT count(*) FILTER (NOT e) AS n_pre, count(*) FILTER (e) AS n_post, avg(x) FILTER (NOT e) AS mean_pre,
                avg(x) FILTER (e) AS mean_post, var_samp(x) FILTER (NOT e) AS v_pre, var_samp(x) FILTER (e) AS v_post,
                avg(CASE WHEN x>=200 THEN 1.0e0 ELSE 0 END) FILTER (NOT e) AS s_pre, avg(CASE WHEN x>=200 THEN 1.0e0 ELSE 0 END) FILTER (e) AS s_post FROM sc))""",
        _SCORED, _RANKS,
    ),
)
def era_scoring_test(spark, sf):
    return out(T.era_scoring_test(S.matches(spark, sf, stages=False)))


@query(
    "mann_whitney_eras",
    sql(
        f"SELECT CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, {q6('u')} AS u, {q6('z')} AS z,"
        f" {q6('CASE WHEN z<=0 THEN 1.0e0 ELSE ' + normal_p_sql('z') + ' END')} AS p_value FROM mw",
        _SCORED, _RANKS,
    ),
)
def mann_whitney_eras(spark, sf):
    m = S.matches(spark, sf, stages=False).where(T.SCORED)
    return out(T.mann_whitney(m, "first_innings_runs", F.col("impact_era")))


@query(
    "margin_summary",
    sql(
        "SELECT margin_type, count(*) AS count, " + ", ".join(
            f"{q6(e)} AS {n}" for e, n in [
                ("avg(margin_value)", "mean"), ("stddev_samp(margin_value)", "std"), ("min(margin_value)", "min"),
                ("quantile_cont(margin_value,0.25)", "p25"), ("quantile_cont(margin_value,0.5)", "p50"),
                ("quantile_cont(margin_value,0.75)", "p75"), ("max(margin_value)", "max")])
        + " FROM m WHERE is_decided AND NOT dls_flag AND margin_type IS NOT NULL GROUP BY margin_type"
    ),
)
def margin_summary(spark, sf):
    return out(T.margin_summary(S.matches(spark, sf, stages=False)))


@query(
    "closest_finishes",
    sql(
        """SELECT match_id, strftime(date,'%Y-%m-%d') AS date, season_year, team1, team2, winner, super_over_winner, result_type, margin_type,
        margin_value, venue, stage, closeness FROM (SELECT *, CASE WHEN result_type='tie' THEN 0 ELSE margin_value END AS closeness FROM m
        WHERE result_type='tie' OR (margin_type='runs' AND NOT dls_flag)) ORDER BY closeness, m.date, match_id LIMIT 10""".replace("m.date", "date")
    ),
)
def closest_finishes(spark, sf):
    return out(
        T.closest_finishes(S.matches(spark, sf)), "match_id", "date", "season_year", "team1", "team2", "winner",
        "super_over_winner", "result_type", "margin_type", "margin_value", "venue", "stage", "closeness",
    )


@query(
    "potm_leaderboard",
    sql(
        """SELECT b.player, count(*) AS awards, min(season_year) AS first, max(season_year) AS last,
        array_to_string(list_sort(list_distinct(list(CAST(team AS VARCHAR)))), ', ') AS teams
        FROM best b JOIN m USING (match_id) LEFT JOIN players p ON p.match_id = b.match_id AND p.player = b.player
        GROUP BY b.player ORDER BY awards DESC, last DESC, b.player LIMIT 15""",
        POTM, SQUADS,
    ),
)
def potm_leaderboard(spark, sf):
    m = S.matches(spark, sf, stages=False)
    return out(T.potm_leaderboard(m, S.squads(spark, sf)), "player", "awards", "first", "last", "teams")


@query(
    "appearances",
    sql(
        """SELECT player, count(DISTINCT match_id) AS matches, count(DISTINCT season_year) AS seasons,
        array_to_string(list_sort(list_distinct(list(CAST(team AS VARCHAR)))), ', ') AS teams
        FROM players JOIN m USING (match_id) GROUP BY player ORDER BY matches DESC, player LIMIT 15""",
        SQUADS,
    ),
)
def appearances(spark, sf):
    return out(T.appearances(S.squads(spark, sf), S.base_contests(spark, sf)), "player", "matches", "seasons", "teams")


@query("squads_long", sql("SELECT match_id, team, player, slot_no FROM players", SQUADS))
def squads_long(spark, sf):
    return out(S.squads(spark, sf))


@query(
    "squad_continuity",
    sql(
        f"""SELECT team, season_year, {q6('avg(len(list_intersect(prev, sq))*1.0e0/len(list_distinct(list_concat(prev, sq))))')} AS mean_jaccard, count(*) AS transitions
        FROM (SELECT *, lag(sq) OVER w AS prev, lag(season_year) OVER w AS ps FROM
               (SELECT match_id, team, list(player) AS sq, min(season_year) AS season_year, min(date) AS date FROM players JOIN m USING (match_id) GROUP BY 1, 2)
              WINDOW w AS (PARTITION BY team ORDER BY date, match_id))
        WHERE ps = season_year GROUP BY team, season_year""",
        SQUADS,
    ),
)
def squad_continuity(spark, sf):
    return out(T.squad_continuity(S.squads(spark, sf), S.base_contests(spark, sf)), "team", "season_year", "mean_jaccard", "transitions")


@query(
    "officials_table",
    sql(
        f"""SELECT official, count(DISTINCT match_id) AS matches, min(season_year) AS first, max(season_year) AS last,
        {q6('avg(CAST(bat_first_won AS BIGINT))')} AS bat_first_win_rate
        FROM (SELECT match_id, season_year, bat_first_won, umpire1 AS official FROM m UNION ALL
              SELECT match_id, season_year, bat_first_won, umpire2 FROM m) GROUP BY official HAVING count(DISTINCT match_id) >= 20"""
    ),
)
def officials_table(spark, sf):
    return out(T.officials_table(S.matches(spark, sf, stages=False)))


# -- quality ----------------------------------------------------------------------------------

#: Every column of the contest table by its type.
_BY_TYPE = {
    "bigint": "league season_year match_id venue_id team1 team2 team1_runs team2_runs team1_wickets team2_wickets toss_winner player_of_match umpire1 umpire2"
    " winner bat_first chasing_team win_by_runs win_by_wickets margin_value super_over_winner match_number season_champion",
    "int": "day", "date": "date",
    "string": "date_raw venue toss_decision result_type margin_type stage",
    "double": "first_innings_runs second_innings_runs first_innings_wickets second_innings_wickets",
    "boolean": "team1_home team2_home team1_bats_first is_decided bat_first_won toss_winner_won voided dls_heuristic dls_external impact_era scores_usable"
    " dls_flag is_playoff is_final",
}
_TYPES = {c: t for t, cs in _BY_TYPE.items() for c in cs.split()}
# The contest table in SQL with the columns that only the quality report reads.
_WIDE = """
wd AS (SELECT m.*, best.player AS player_of_match, CASE WHEN NOT is_playoff THEN m.match_id END AS match_number,
         CASE WHEN result_type <> 'tie' THEN CAST(CASE WHEN team1_bats_first THEN team1_wickets ELSE team2_wickets END AS DOUBLE) END AS first_innings_wickets,
         CASE WHEN result_type <> 'tie' THEN CAST(CASE WHEN team1_bats_first THEN team2_wickets ELSE team1_wickets END AS DOUBLE) END AS second_innings_wickets
       FROM m LEFT JOIN best USING (match_id))"""


@query(
    "null_counts",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM wd" for c in _TYPES), POTM, _WIDE),
)
def null_counts(spark, sf):
    return out(T.null_counts(S.matches(spark, sf)))


@query(
    "constant_columns",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CASE WHEN count(*) > 0 THEN '{v}' END AS lo, CASE WHEN count(*) > 0 THEN '{v}' END AS hi, CAST(1 AS BIGINT) AS is_constant FROM m"
            for c, v in CONSTANTS.items() if c != "overs_limit"
        )
        + " UNION ALL SELECT 'overs_limit', min(v), max(v), CAST(min(v) = max(v) AS BIGINT) FROM (SELECT CASE WHEN NOT is_playoff AND match_id % 137 = 0 THEN '50' ELSE '20' END AS v FROM m)"
    ),
)
def constant_columns(spark, sf):
    """Columns of the raw texts that should hold one value, with the planted faults."""
    return out(T.constant_columns(RT.raw_text(spark, sf), CONSTANTS))


@query(
    "season_rollup",
    sql(
        f"""SELECT season_year, count(*) AS matches, count(*) FILTER (is_decided) AS decided, count(*) FILTER (result_type='tie') AS ties,
        count(*) FILTER (result_type='no result') AS no_results, strftime(min(date),'%Y-%m-%d') AS first_match,
        strftime(max(date),'%Y-%m-%d') AS last_match, {q6('avg(CAST(team1_bats_first AS BIGINT))')} AS team1_bats_first_share FROM m GROUP BY season_year"""
    ),
)
def season_rollup(spark, sf):
    return out(T.season_rollup(S.matches(spark, sf, stages=False)))


@query(
    "squad_size_crosstab",
    sql(
        """SELECT season_year, k AS size, count(*) AS contests
        FROM (SELECT m.match_id, any_value(season_year) AS season_year, count(player) AS k FROM m LEFT JOIN players p
              ON p.match_id=m.match_id AND p.team=m.team1 GROUP BY m.match_id) GROUP BY season_year, k""",
        SQUADS,
    ),
)
def squad_size_crosstab(spark, sf):
    """Contests of every season and squad size that occurs."""
    return out(T.squad_size_counts(S.squads(spark, sf), S.base_contests(spark, sf)))


@query("stage_value_counts", sql("SELECT stage, count(*) AS rows FROM m GROUP BY stage"))
def stage_value_counts(spark, sf):
    return out(T.value_counts(S.matches(spark, sf), "stage"))


@query(
    "identity_counts",
    sql(
        """SELECT 'sides' AS name, count(DISTINCT team) AS distinct_values FROM long UNION ALL
        SELECT 'venues', count(DISTINCT venue_id) FROM m UNION ALL
        SELECT 'officials', count(DISTINCT o) FROM (SELECT umpire1 AS o FROM m UNION SELECT umpire2 FROM m)""",
        LONG,
    ),
)
def identity_counts(spark, sf):
    named = {"sides": ["team1", "team2"], "venues": ["venue_id"], "officials": ["umpire1", "umpire2"]}
    return out(T.distinct_counts(S.base_contests(spark, sf), named))


@query(
    "exception_listing",
    sql(
        """SELECT match_id, date_raw, team1, team2, winner, CAST(dls_heuristic AS BIGINT) AS dls_heuristic,
        CAST(dls_external AS BIGINT) AS dls_external, super_over_winner, CAST(voided AS BIGINT) AS voided
        FROM m WHERE dls_flag OR voided OR result_type='tie'"""
    ),
)
def exception_listing(spark, sf):
    m = S.matches(spark, sf, stages=False).where("dls_flag OR voided OR result_type = 'tie'")
    return out(m, "match_id", "date_raw", "team1", "team2", "winner", "dls_heuristic", "dls_external", "super_over_winner", "voided")


@query(
    "data_dictionary",
    sql(
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, substr(CAST(min({c}) AS VARCHAR), 1, 40) AS example FROM wd" for c, t in _TYPES.items()),
        POTM, _WIDE,
    ),
)
def data_dictionary(spark, sf):
    return out(T.data_dictionary(S.matches(spark, sf)))
