"""Shared pieces of the registered queries and of their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.stats import Z_975, r6
from contestry.session import Stage

# The canonical contest table, restated in plain SQL.
CONTESTS = """
sides AS (
  SELECT l_orderkey, l_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS runs, COUNT(*) AS n_lines,
         MIN(l_linenumber) AS first_line
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_suppkey) AS side_no FROM sides),
m0 AS (
SELECT o.o_orderkey * 1000003 + a.side_no // 2 AS match_id, CAST(o.o_orderdate AS DATE) AS date,
       CAST(year(o.o_orderdate) AS BIGINT) AS season_year, CAST(n.n_regionkey AS BIGINT) AS league,
       CAST(c.c_nationkey AS BIGINT) AS venue_id, n.n_name AS venue,
       a.l_suppkey AS team1, b.l_suppkey AS team2, a.runs AS team1_runs, b.runs AS team2_runs,
       CAST(a.n_lines % 10 AS BIGINT) AS team1_wickets, CAST(b.n_lines % 10 AS BIGINT) AS team2_wickets,
       CASE WHEN o.o_orderkey % 2 = 0 THEN a.l_suppkey ELSE b.l_suppkey END AS toss_winner,
       CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'bat' ELSE 'field' END AS toss_decision,
       CASE WHEN o.o_orderstatus='P' AND o.o_orderkey % 25 = 0 THEN 'no result'
            WHEN a.runs = b.runs THEN 'tie' ELSE 'complete' END AS result_type,
       s1.s_nationkey = c.c_nationkey AS team1_home, s2.s_nationkey = c.c_nationkey AS team2_home,
       o.o_custkey AS umpire1, o.o_orderkey % 40 AS umpire2
FROM orders o
JOIN r a ON a.l_orderkey = o.o_orderkey AND a.side_no % 2 = 1
JOIN r b ON b.l_orderkey = o.o_orderkey AND b.side_no = a.side_no + 1
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN supplier s1 ON s1.s_suppkey = a.l_suppkey JOIN supplier s2 ON s2.s_suppkey = b.l_suppkey),
m1 AS (
SELECT *, strftime(date, '%d-%m-%Y') AS date_raw, CAST(date - DATE '1970-01-01' AS INTEGER) AS day,
       CASE WHEN result_type='complete' THEN CASE WHEN team1_runs > team2_runs THEN team1 ELSE team2 END END AS winner,
       CASE WHEN toss_decision='bat' THEN toss_winner WHEN toss_winner=team1 THEN team2 ELSE team1 END AS bat_first,
       result_type='complete' AS is_decided
FROM m0),
m2 AS (
SELECT *, bat_first = team1 AS team1_bats_first,
       CASE WHEN bat_first = team1 THEN team2 ELSE team1 END AS chasing_team,
       CASE WHEN is_decided THEN winner = bat_first END AS bat_first_won,
       CASE WHEN is_decided THEN winner = toss_winner END AS toss_winner_won,
       CASE WHEN is_decided AND ((winner = bat_first) <> (match_id % 41 = 0))
            THEN abs(team1_runs - team2_runs) ELSE 0 END AS win_by_runs,
       CASE WHEN is_decided AND NOT ((winner = bat_first) <> (match_id % 41 = 0))
            THEN 10 - CASE WHEN winner = team1 THEN team1_wickets ELSE team2_wickets END ELSE 0 END AS win_by_wickets
FROM m1),
m3 AS (
SELECT *, CASE WHEN is_decided AND win_by_wickets > 0 THEN 'wickets'
               WHEN is_decided AND win_by_runs > 0 THEN 'runs' END AS margin_type,
       result_type='no result' AND match_id % 50 = 0 AS voided,
       result_type <> 'no result' AS scores_usable,
       CASE WHEN result_type='tie' THEN CAST(team1_runs - match_id % 3 AS DOUBLE)
            WHEN team1_bats_first THEN CAST(team1_runs AS DOUBLE) ELSE CAST(team2_runs AS DOUBLE) END AS first_innings_runs,
       CASE WHEN result_type='tie' THEN CAST(team1_runs - match_id % 3 AS DOUBLE)
            WHEN team1_bats_first THEN CAST(team2_runs AS DOUBLE) ELSE CAST(team1_runs AS DOUBLE) END AS second_innings_runs,
       CASE WHEN result_type='tie' THEN CASE WHEN match_id % 2 = 0 THEN team1 ELSE team2 END END AS super_over_winner,
       coalesce((bat_first_won AND win_by_wickets > 0) OR (NOT bat_first_won AND win_by_runs > 0), FALSE) AS dls_heuristic,
       match_id % 97 = 0 AS dls_external,
       season_year >= 1999 AS impact_era,
       ROW_NUMBER() OVER (PARTITION BY league, season_year ORDER BY date DESC, match_id DESC) AS from_end
FROM m2),
m AS (
SELECT *, CASE margin_type WHEN 'runs' THEN win_by_runs WHEN 'wickets' THEN win_by_wickets END AS margin_value,
       dls_heuristic OR dls_external AS dls_flag,
       CASE from_end WHEN 1 THEN 'final' WHEN 2 THEN 'qualifier_2' WHEN 3 THEN 'eliminator' WHEN 4 THEN 'qualifier_1'
            ELSE 'league' END AS stage,
       from_end <= 4 AS is_playoff, from_end = 1 AS is_final,
       max(CASE WHEN from_end = 1 THEN winner END) OVER (PARTITION BY league, season_year) AS season_champion
FROM m3)"""

LONG = """
long AS (
SELECT match_id, date, day, season_year, league, venue_id, stage, is_decided, voided, result_type, team1 AS team, team2 AS opponent,
       team1_home AS is_home, team2_home AS opp_home, bat_first = team1 AS bats_first,
       CASE WHEN is_decided THEN winner = team1 END AS won,
       CASE WHEN scores_usable AND result_type <> 'tie' THEN team1_runs END AS runs_for,
       CASE WHEN scores_usable AND result_type <> 'tie' THEN team2_runs END AS runs_against FROM m
UNION ALL
SELECT match_id, date, day, season_year, league, venue_id, stage, is_decided, voided, result_type, team2, team1, team2_home, team1_home,
       bat_first = team2, CASE WHEN is_decided THEN winner = team2 END,
       CASE WHEN scores_usable AND result_type <> 'tie' THEN team2_runs END,
       CASE WHEN scores_usable AND result_type <> 'tie' THEN team1_runs END FROM m)"""

POTM = """
best AS (SELECT m.match_id, arg_max(l_partkey, l_extendedprice * 1000000000 - l_partkey) AS player
         FROM lineitem JOIN m ON l_orderkey = match_id // 1000003 AND l_suppkey IN (team1, team2)
         WHERE result_type <> 'no result' GROUP BY m.match_id)"""

SQUADS = """
players AS (SELECT match_id, team, player,
              ROW_NUMBER() OVER (PARTITION BY match_id, team ORDER BY player) AS slot_no
            FROM (SELECT DISTINCT match_id, l_suppkey AS team, l_partkey AS player
                  FROM lineitem JOIN m ON l_orderkey = match_id // 1000003 AND l_suppkey IN (team1, team2)))"""


def sql(body: str, *ctes: str) -> str:
    """WITH the contest table and the named CTEs, then ``body``."""
    return "WITH RECURSIVE " + ",".join([CONTESTS, *ctes]) + "\n" + body


def q6(e: str, digits: int = 6) -> str:
    """SQL twin of ``r6``."""
    tiny = 0.5 * 10**-digits
    return f"CASE WHEN abs({e}) < {tiny:.12f} THEN CAST(0 AS DOUBLE) ELSE round(CAST({e} AS DOUBLE), {digits}) END"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) END)"


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    z = repr(Z_975) + "e0"
    p = f"(CAST({s} AS DOUBLE)/({n}))"
    d = f"(1+{z}*{z}/({n}))"
    c = f"(({p}+{z}*{z}/(2*({n})))/{d})"
    h = f"({z}*sqrt({p}*(1-{p})/({n})+{z}*{z}/(4.0*({n})*({n})))/{d})"
    return (
        f"CASE WHEN ({n})>0 THEN greatest(0.0e0, {c}-{h}) END",
        f"CASE WHEN ({n})>0 THEN least(1.0e0, {c}+{h}) END",
    )


def binom_half_sql(k: str, n: str) -> str:
    """Exact two-sided test at one half, by summing the smaller tail."""
    lo = f"least({k}, {n}-{k})"
    tail = (
        f"list_sum(list_transform(range(0, CAST({lo} AS BIGINT)+1), lambda i: "
        f"exp(lgamma({n}+1)-lgamma(i+1)-lgamma({n}-i+1)-({n})*ln(2.0e0))))"
    )
    return f"CASE WHEN ({n})=0 THEN NULL WHEN 2*({k})=({n}) THEN 1.0e0 ELSE least(1.0e0, 2*{tail}) END"


def simpson_sql(density: str, upper: str, steps: int = 2000) -> str:
    """Integral of ``density`` (in ``x``) from 0 to ``upper``."""
    h = f"(({upper})/{steps}.0e0)"
    f = density.replace("{x}", f"(i*{h})")
    return (
        f"(list_sum(list_transform(range(0, {steps}+1), lambda i: "
        f"(CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*({f})))*{h}/3.0e0)"
    )


def normal_p_sql(z: str) -> str:
    return f"greatest(0.0e0, 1-2*{simpson_sql('exp(-{x}*{x}/2)/sqrt(2*pi())', f'abs({z})')})"


def t_p_sql(t: str, df: str) -> str:
    dens = f"exp(lgamma((({df})+1)/2)-lgamma(({df})/2)-(({df})+1)/2*ln(1+{{x}}*{{x}}/({df})))/sqrt(({df})*pi())"
    return f"greatest(0.0e0, 1-2*{simpson_sql(dens, f'abs({t})')})"


def out(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Comparable form: rounded doubles, long integers, dates as text, flags as 0/1."""
    types = dict(df.dtypes)

    def shape(c: str) -> Column:
        t = types[c]
        if t in ("double", "float") or t.startswith("decimal"):
            return r6(c, digits).alias(c)
        if t in ("int", "smallint", "tinyint", "bigint"):
            return F.col(c).cast("long").alias(c)
        if t == "boolean":
            return F.col(c).cast("long").alias(c)
        if t == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.col(c)

    return df.select(*[shape(c) for c in (cols or df.columns)])


def id_sum(c: str) -> Column:
    """The sum of ids with every digit."""
    return F.sum(F.col(c).cast("decimal(38,0)"))


def exact_sums(df: DataFrame, label: str, *cols: str) -> DataFrame:
    """Grouped rows whose decimal sums ``cols`` are long where all of them fit, else decimal(38, 0) with every digit.

    Sums of ids pass a long long before the ids do. The rows, one a group, are written, so that they are summed once.
    """
    rows = Stage(df.sparkSession, label).write(df, "sums")
    wide = rows.agg(*[F.max(F.abs(c) > (1 << 63) - 1).alias(c) for c in cols]).first()  # a flag a column
    return rows.withColumns({c: F.col(c).cast("decimal(38,0)" if wide[c] else "long") for c in cols})
