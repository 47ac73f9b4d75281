"""Registered queries: as-of features and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.catalog.base import LONG, SQUADS, POTM, out, q6, sql
from contestry.functions.text import orientation_flip
from contestry.operators import asof as A
from contestry.operators import elo as E
from contestry.sources import contests as S

Q, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


PRIOR = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

COIN = """
coin AS (SELECT match_id, ('0x' || substr(sha256('42|' || date_raw || '|' || least(team1,team2) || '|' || greatest(team1,team2)), 1, 2))::INTEGER & 1 = 1 AS flip FROM m)"""

# ``hist`` gates every input, so the same text serves training (all true) and fixtures.
EVENTS = """
ev AS (SELECT *, CASE WHEN hist AND is_decided THEN CASE WHEN won THEN 1.0e0 ELSE 0.0e0 END WHEN hist AND result_type='tie' THEN 0.5e0 END AS result,
         CASE WHEN hist THEN CAST(runs_for AS DOUBLE) END AS rf, CASE WHEN hist THEN CAST(runs_against AS DOUBLE) END AS ra
       FROM (SELECT *, {hist} AS hist FROM long))"""
FORM = f"""
sq AS (SELECT *, count(result) OVER (PARTITION BY league, team ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS rs,
         count(result) OVER (PARTITION BY league, team ORDER BY day {PRIOR}) AS rk,
         count(rf) OVER (PARTITION BY league, team ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS us,
         count(rf) OVER (PARTITION BY league, team ORDER BY day {PRIOR}) AS uk,
         sum(result) OVER (PARTITION BY league, team ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS rc,
         sum(rf) OVER (PARTITION BY league, team ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS fc,
         sum(ra) OVER (PARTITION BY league, team ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS ac,
         coalesce(sum(CAST(result = 1 AS INT)) OVER (PARTITION BY league, team, season_year ORDER BY day {PRIOR}), 0) AS sw,
         count(result) OVER (PARTITION BY league, team, season_year ORDER BY day {PRIOR}) AS sg,
         least(30, coalesce(day - max(CASE WHEN hist THEN day END) OVER (PARTITION BY league, team ORDER BY day {PRIOR}), 30)) AS rest
       FROM ev),
cr AS (SELECT league, team, rs, max(rc) AS c FROM sq WHERE result IS NOT NULL GROUP BY 1, 2, 3),
cu AS (SELECT league, team, us, max(fc) AS f, max(ac) AS a FROM sq WHERE rf IS NOT NULL GROUP BY 1, 2, 3),
lg AS (SELECT match_id, coalesce(sum(x) OVER w / nullif(count(x) OVER w, 0), 160) AS league_runs,
         coalesce(sum(b) OVER w * 1.0e0 / nullif(count(b) OVER w, 0), 0.5e0) AS league_bf,
         sum(x) OVER v AS vx, count(x) OVER v AS vn, sum(b) OVER v AS vb, count(b) OVER v AS vd
       FROM (SELECT *, CASE WHEN HIST AND scores_usable THEN first_innings_runs END AS x, CASE WHEN HIST THEN CAST(bat_first_won AS INT) END AS b FROM m)
       WINDOW w AS (PARTITION BY league ORDER BY day {PRIOR}), v AS (PARTITION BY league, venue_id ORDER BY day {PRIOR})),
form AS (SELECT sq.match_id, sq.league, sq.team, sq.day, sq.hist,
         (coalesce(a.c,0)-coalesce(b5.c,0)+1)/(least(rk,5)+2) AS form5, (coalesce(a.c,0)-coalesce(b10.c,0)+1)/(least(rk,10)+2) AS form10,
         CASE WHEN uk>0 THEN (u.f-coalesce(v.f,0))/least(uk,10) ELSE lg.league_runs END AS runs_for10,
         CASE WHEN uk>0 THEN (u.a-coalesce(v.a,0))/least(uk,10) ELSE lg.league_runs END AS runs_against10,
         (sw+1.0e0)/(sg+2) AS season_winpct, CAST(sg AS DOUBLE) AS season_games, CAST(rest AS DOUBLE) AS rest_days
       FROM sq JOIN lg ON lg.match_id = sq.match_id
       LEFT JOIN cr a ON a.league=sq.league AND a.team=sq.team AND a.rs=rk
       LEFT JOIN cr b5 ON b5.league=sq.league AND b5.team=sq.team AND b5.rs=rk-5
       LEFT JOIN cr b10 ON b10.league=sq.league AND b10.team=sq.team AND b10.rs=rk-10
       LEFT JOIN cu u ON u.league=sq.league AND u.team=sq.team AND u.us=uk
       LEFT JOIN cu v ON v.league=sq.league AND v.team=sq.team AND v.us=uk-10)"""
VENUE = """
vs AS (SELECT match_id, (coalesce(vx,0)+10*league_runs)/(vn+10) AS venue_first_innings,
         (coalesce(vb,0)+10*league_bf)/(vd+10) AS venue_bat_first_rate FROM lg)"""
SIDE_VENUE = f"""
sv AS (SELECT match_id, team, (coalesce(sum(CASE WHEN hist AND is_decided THEN result END) OVER w, 0)+2.5e0)
         /(count(CASE WHEN hist AND is_decided THEN 1 END) OVER w + 5) AS venue_rate
       FROM ev WINDOW w AS (PARTITION BY league, team, venue_id ORDER BY day {PRIOR}))"""
PAIR = f"""
h2 AS (SELECT match_id, least(team1,team2) AS lo, coalesce(sum(lw) OVER d, 0) AS lw, count(lw) OVER d AS n,
         coalesce(sum(lw) OVER d, 0)-coalesce(sum(lw) OVER s, 0) AS rlw, count(lw) OVER d - count(lw) OVER s AS rn
       FROM (SELECT *, CASE WHEN HIST AND is_decided THEN CAST(winner = least(team1,team2) AS INT) END AS lw FROM m)
       WINDOW d AS (PARTITION BY league, least(team1,team2), greatest(team1,team2) ORDER BY day {PRIOR}),
              s AS (PARTITION BY league, least(team1,team2), greatest(team1,team2) ORDER BY season_year RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING))"""
SQUAD = f"""
pl AS (SELECT p.match_id, p.team, p.player, m.league, m.day, coalesce(b.player = p.player, FALSE) AS aw
       FROM players p JOIN m ON m.match_id = p.match_id LEFT JOIN best b ON b.match_id = p.match_id),
pk AS (SELECT *, count(*) OVER w AS caps, coalesce(sum(CAST(aw AS INT)) OVER w, 0) AS awards
       FROM pl WINDOW w AS (PARTITION BY league, player ORDER BY day {PRIOR})),
sx AS (SELECT match_id, team, min(league) AS league, min(day) AS day, list(player) AS xi, sum(caps)/100.0e0 AS xi_experience,
         CAST(sum(awards) AS DOUBLE) AS xi_potm, CAST(count(*) FILTER (caps = 0) AS DOUBLE) AS xi_debutants FROM pk GROUP BY 1, 2),
pv AS (SELECT *, lag(last_xi) OVER (PARTITION BY league, team ORDER BY day) AS prev FROM
        (SELECT league, team, day, arg_max(xi, match_id) AS last_xi FROM sx GROUP BY 1, 2, 3)),
sf AS (SELECT sx.match_id, sx.team, xi_experience, xi_potm, xi_debutants,
         CASE WHEN prev IS NULL THEN 0.0e0 ELSE len(list_intersect(prev, xi))*1.0e0/len(list_distinct(list_concat(prev, xi))) END AS xi_continuity
       FROM sx JOIN pv ON pv.league=sx.league AND pv.team=sx.team AND pv.day=sx.day)"""
HALF = "TRUE"
SPLIT = "season_year <= 1999"


def fsql(body: str, *ctes: str, hist: str = HALF) -> str:
    return sql(body, *[c.replace("HIST", hist).replace("{hist}", hist) for c in ctes])


FORM_OUT = ", ".join(f"{q6(c)} AS {c}" for c in A.FORM_FIELDS)


@query("orientation_flip", sql("SELECT match_id, CAST(flip AS BIGINT) AS flip FROM coin", COIN))
def orientation(spark, sf):
    m = S.base_contests(spark, sf)
    return out(m.select("match_id", orientation_flip(S.SEED, F.col("date_raw"), F.col("team1"), F.col("team2")).alias("flip")))


@query("asof_form", fsql(f"SELECT match_id, team, {FORM_OUT} FROM form", LONG, EVENTS, FORM))
def asof_form(spark, sf):
    return out(A.side_snapshots(S.stored(spark, sf)["matches"]), "match_id", "team", *A.FORM_FIELDS)


@query("asof_side_at_venue", fsql(f"SELECT match_id, team, {q6('venue_rate')} AS venue_rate FROM sv", LONG, EVENTS, SIDE_VENUE))
def asof_side_at_venue(spark, sf):
    ev = A.side_events(S.stored(spark, sf)["matches"])
    st = A.side_venue_state(ev)
    return out(ev.join(st, ["league", "team", "venue_id", "day"]), "match_id", "team", "venue_rate")


_PAIR_OUT = (
    f"SELECT match_id, n AS meetings, {q6('(2*lw-n)/(n+2.0e0)')} AS edge_lo, rn AS recent_meetings,"
    f" {q6('(2*rlw-rn)/(rn+2.0e0)')} AS recent_edge_lo FROM h2"
)


@query("asof_head_to_head", fsql(_PAIR_OUT, PAIR))
def asof_head_to_head(spark, sf):
    m = S.stored(spark, sf)["matches"]
    j = m.selectExpr("match_id", "league", "day", "least(team1, team2) AS lo", "greatest(team1, team2) AS hi")
    x = j.join(A.pair_state(m), ["league", "lo", "hi", "day"]).selectExpr(
        "match_id", "all_n AS meetings", "(2 * all_lw - all_n) / (all_n + 2D) AS edge_lo", "rec_n AS recent_meetings",
        "(2 * rec_lw - rec_n) / (rec_n + 2D) AS recent_edge_lo",
    )
    return out(x)


@query(
    "asof_venue",
    fsql(
        f"SELECT match_id, {q6('venue_first_innings')} AS venue_first_innings, {q6('venue_bat_first_rate')} AS venue_bat_first_rate FROM vs",
        LONG, EVENTS, FORM, VENUE,
    ),
)
def asof_venue(spark, sf):
    m = S.stored(spark, sf)["matches"]
    return out(m.join(A.venue_state(m), ["league", "venue_id", "day"]), "match_id", "venue_first_innings", "venue_bat_first_rate")


_SQ = ("xi_experience", "xi_potm", "xi_debutants", "xi_continuity")


@query("asof_squad", fsql("SELECT match_id, team, " + ", ".join(f"{q6(c)} AS {c}" for c in _SQ) + " FROM sf", POTM, SQUADS, SQUAD))
def asof_squad(spark, sf):
    m = S.stored(spark, sf)["matches"]
    return out(A.squad_state(m, S.stored(spark, sf)["players"]), "match_id", "team", *_SQ)


@query(
    "league_recent_mean",
    sql(
        f"""SELECT q.match_id, {q6('(c.s-coalesce(d.s,0))/least(k,74)')} AS league_recent_first_innings
        FROM q LEFT JOIN (SELECT league, u, max(s) AS s FROM q WHERE x IS NOT NULL GROUP BY 1, 2) c ON c.league=q.league AND c.u=k
        LEFT JOIN (SELECT league, u, max(s) AS s FROM q WHERE x IS NOT NULL GROUP BY 1, 2) d ON d.league=q.league AND d.u=k-74""",
        f"""q AS (SELECT match_id, league, x, count(x) OVER (PARTITION BY league ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS u,
          sum(x) OVER (PARTITION BY league ORDER BY day, match_id ROWS UNBOUNDED PRECEDING) AS s,
          count(x) OVER (PARTITION BY league ORDER BY day {PRIOR}) AS k
          FROM (SELECT *, CASE WHEN scores_usable THEN first_innings_runs END AS x FROM m))""",
    ),
)
def league_recent_mean(spark, sf):
    m = S.stored(spark, sf)["matches"]
    return out(m.join(A.league_recent_mean(m), ["league", "day"]), "match_id", "league_recent_first_innings")


PF = """
pf AS (SELECT m.match_id, m.season_year, m.stage, m.is_decided, m.day, m.league, CASE WHEN flip THEN team2 ELSE team1 END AS team_a, CASE WHEN flip THEN team1 ELSE team2 END AS team_b,
         CASE WHEN m.is_decided THEN CAST(winner = CASE WHEN flip THEN team2 ELSE team1 END AS INT) END AS a_wins,
         (CASE WHEN flip THEN -1 ELSE 1 END)*(CAST(team1_home AS INT)-CAST(team2_home AS INT)) AS home_diff,
         fa.form5-fb.form5 AS form5_diff, fa.form10-fb.form10 AS form10_diff, fa.runs_for10-fb.runs_for10 AS runs_for10_diff,
         fa.runs_against10-fb.runs_against10 AS runs_against10_diff, fa.season_winpct-fb.season_winpct AS season_winpct_diff,
         fa.season_games-fb.season_games AS season_games_diff, fa.rest_days-fb.rest_days AS rest_days_diff,
         (CASE WHEN fa.team=lo THEN 1 ELSE -1 END)*(2*lw-n)/(n+2.0e0) AS h2h_edge,
         (CASE WHEN fa.team=lo THEN 1 ELSE -1 END)*(2*rlw-rn)/(rn+2.0e0) AS h2h_recent_edge,
         va.venue_rate-vb.venue_rate AS venue_team_edge, n AS h2h_meetings, venue_first_innings, venue_bat_first_rate,
         CAST(is_playoff AS INT) AS is_playoff, CAST(impact_era AS INT) AS impact_era,
         CASE WHEN bat_first=fa.team THEN 1 ELSE -1 END AS a_bats_first, CASE WHEN toss_winner=fa.team THEN 1 ELSE -1 END AS a_won_toss,
         (CASE WHEN bat_first=fa.team THEN 1 ELSE -1 END)*(venue_bat_first_rate-0.5e0) AS bats_first_x_venue,
         (CASE WHEN bat_first=fa.team THEN 1 ELSE -1 END)*CAST(impact_era AS INT) AS bats_first_x_impact
       FROM m JOIN coin ON coin.match_id=m.match_id
       JOIN form fa ON fa.match_id=m.match_id AND fa.team=CASE WHEN flip THEN team2 ELSE team1 END
       JOIN form fb ON fb.match_id=m.match_id AND fb.team=CASE WHEN flip THEN team1 ELSE team2 END
       JOIN sv va ON va.match_id=m.match_id AND va.team=fa.team JOIN sv vb ON vb.match_id=m.match_id AND vb.team=fb.team
       JOIN h2 ON h2.match_id=m.match_id JOIN vs ON vs.match_id=m.match_id)"""
PF_SQUAD = """
ps AS (SELECT pf.*, sa.xi_experience-sb.xi_experience AS xi_experience_diff, sa.xi_potm-sb.xi_potm AS xi_potm_diff,
         sa.xi_debutants-sb.xi_debutants AS xi_debutants_diff, sa.xi_continuity-sb.xi_continuity AS xi_continuity_diff
       FROM pf JOIN sf sa ON sa.match_id=pf.match_id AND sa.team=team_a JOIN sf sb ON sb.match_id=pf.match_id AND sb.team=team_b)"""
PF_CTES = (LONG, COIN, EVENTS, FORM, VENUE, SIDE_VENUE, PAIR, PF)
NO_ELO = [c for c in A.feature_names("post_toss") if c != "elo_diff"]


def _fcols(cols, sign=lambda c: "") -> str:
    return ", ".join(f"{q6(f'({sign(c)}{c})')} AS {c}" for c in cols)


@query(
    "pair_features",
    fsql(
        f"SELECT match_id, team_a, team_b, CAST(a_wins AS BIGINT) AS a_wins, {_fcols(NO_ELO)} FROM ps",
        *PF_CTES, POTM, SQUADS, SQUAD, PF_SQUAD,
    ),
)
def pair_features(spark, sf):
    m = S.stored(spark, sf)["matches"]
    f = A.pair_features(m, S.stored(spark, sf)["players"])
    return out(f.withColumn("a_wins", F.col("a_wins").cast("long")), "match_id", "team_a", "team_b", "a_wins", *NO_ELO)


_PRE = [c for c in A.feature_names("pre_toss") if c != "elo_diff"]


@query(
    "swapped_features",
    fsql(f"SELECT match_id, {_fcols(_PRE, lambda c: '-' if c in A.feature_names("pre_toss", -1) else '')} FROM pf", *PF_CTES),
)
def swapped_features(spark, sf):
    f = A.pair_features(S.stored(spark, sf)["matches"])
    return out(A.swapped(f, "pre_toss"), "match_id", *_PRE)


@query(
    "fixture_features_as_of",
    fsql(f"SELECT match_id, team_a, team_b, {_fcols(_PRE)} FROM pf WHERE season_year > 1999", *PF_CTES, hist=SPLIT),
)
def fixture_features(spark, sf):
    """Features of the later seasons' contests as fixtures; only contests up to 1999 are history."""
    m = S.stored(spark, sf)["matches"]
    f = A.pair_features(m.where("season_year <= 1999"), asks=m.where("season_year > 1999"))
    return out(f, "match_id", "team_a", "team_b", *_PRE)


# -- ratings ----------------------------------------------------------------------------------

ELO = """
days AS (SELECT day, row_number() OVER (ORDER BY day) AS t FROM (SELECT DISTINCT day FROM m)),
sdx AS (SELECT league, season_year, row_number() OVER (PARTITION BY league ORDER BY season_year)-1 AS sidx FROM (SELECT DISTINCT league, season_year FROM m)),
g AS MATERIALIZED (SELECT m.match_id, m.league, t, sidx, team1, team2, 30.0e0*(CAST(team1_home AS INT)-CAST(team2_home AS INT)) AS home,
        is_decided OR result_type='tie' AS rated, CASE WHEN result_type='tie' THEN 0.5e0 WHEN winner=team1 THEN 1.0e0 ELSE 0.0e0 END AS score,
        CASE WHEN is_decided AND NOT dls_flag THEN CASE margin_type WHEN 'runs' THEN margin_value/10.0e0 WHEN 'wickets' THEN margin_value/2.0e0 END END AS units
      FROM m JOIN days ON days.day=m.day JOIN sdx ON sdx.league=m.league AND sdx.season_year=m.season_year),
dsx AS MATERIALIZED (SELECT DISTINCT league, t, sidx FROM g),
elo AS (
  SELECT CAST(0 AS BIGINT) AS t, league, team, CAST(1500 AS DOUBLE) AS pre, CAST(1500 AS DOUBLE) AS post, CAST(0 AS BIGINT) AS sidx
  FROM (SELECT league, team1 AS team FROM m UNION SELECT league, team2 FROM m)
  UNION ALL
  SELECT e.t+1, e.league, e.team, 1500+pow(0.67e0, coalesce(d.sidx, e.sidx)-e.sidx)*(e.post-1500),
         1500+pow(0.67e0, coalesce(d.sidx, e.sidx)-e.sidx)*(e.post-1500)+coalesce(u.delta, 0), coalesce(d.sidx, e.sidx)
  FROM elo e LEFT JOIN dsx d ON d.league=e.league AND d.t=e.t+1
  LEFT JOIN (
    SELECT league, team, sum(delta) AS delta FROM (
      SELECT league, unnest([team1, team2]) AS team, unnest([delta, -delta]) AS delta FROM (
        SELECT *, CASE WHEN rated THEN 20*(CASE WHEN units>0 THEN ln(units+1)*2.2e0/(0.001e0*(CASE WHEN score=1 THEN r1-r2 ELSE r2-r1 END)+2.2e0) ELSE 1 END)
                 *(score-1/(1+pow(10.0e0, -(r1-r2+home)/400.0e0))) ELSE 0 END AS delta
        FROM (SELECT g.*, 1500+pow(0.67e0, g.sidx-e1.sidx)*(e1.post-1500) AS r1, 1500+pow(0.67e0, g.sidx-e2.sidx)*(e2.post-1500) AS r2
              FROM g JOIN elo e1 ON e1.league=g.league AND e1.team=g.team1 AND e1.t+1=g.t
                     JOIN elo e2 ON e2.league=g.league AND e2.team=g.team2 AND e2.t+1=g.t)))
    GROUP BY league, team) u ON u.league=e.league AND u.team=e.team
  WHERE e.t < (SELECT max(t) FROM days))"""


@query(
    "elo_ratings",
    sql(
        f"""SELECT m.match_id, m.league, {q6('a.pre', 4)} AS rating_1, {q6('b.pre', 4)} AS rating_2 FROM m JOIN days ON days.day=m.day
        JOIN elo a ON a.league=m.league AND a.t=days.t AND a.team=team1 JOIN elo b ON b.league=m.league AND b.t=days.t AND b.team=team2""",
        ELO,
    ),
)
def elo_ratings(spark, sf):
    ratings, games = E.solve(S.stored(spark, sf)["matches"])
    j = E._deltas(games, ratings).selectExpr("match_id", "league", "r1 AS rating_1", "r2 AS rating_2")
    return out(j, digits=4)


@query(
    "elo_leaders",
    sql(f"SELECT league, team, {q6('post', 4)} AS rating FROM elo WHERE t=(SELECT max(t) FROM days) ORDER BY post DESC, league, team LIMIT 10", ELO),
)
def elo_leaders(spark, sf):
    """Latest ratings, every side brought to the end of the league's last season."""
    ratings, games = S.stored_ratings(spark, sf)
    return out(E.current(games, ratings).orderBy(F.desc("rating"), "league", "team").limit(10), "league", "team", "rating", digits=4)
