"""Registered queries: sinks and guarded scans, strict validation, logs, grids and the summary.

The sink queries write a table that derives from the given ones, read it back and return what came back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.catalog import models as MO
from contestry.catalog import records as RE
from contestry.catalog.base import LONG, POTM, SQUADS, exact_sums, id_sum, out, q6, sql
from contestry.catalog.features import PF_CTES, fsql
from contestry.catalog.ingest import CHECKED
from contestry.operators import append as AP
from contestry.operators import asof as A
from contestry.operators import cleaning as C
from contestry.operators import scoring as SC
from contestry.operators import store as ST
from contestry.operators import validate as V
from contestry.operators.records import count_rows
from contestry.plans.summary import analytics_summary
from contestry.session import Stage
from contestry.sources import contests as S
from contestry.sources import files as FI
from contestry.sources import rawtext as RT

Q, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


def _m(spark, sf):
    return S.stored(spark, sf)["matches"]


def _refused(check, *args) -> int:
    """1 if ``check`` refuses its arguments."""
    try:
        check(*args)
    except (FileNotFoundError, ValueError):
        return 1
    return 0


def _with_cases(rows, cases: dict[str, int], name: str):
    """One row per case beside the single row of ``rows``."""
    items = F.array(*[F.struct(F.lit(k).alias(name), F.lit(v).alias("refused")) for k, v in cases.items()])
    return rows.withColumn("_c", F.explode(items)).select("_c.*", *rows.columns)


# -- scans and guards -------------------------------------------------------------------------

_OLD = "CASE WHEN season_year <= 1997 AND {0} % 3 = 0 THEN 'Old ' || {1}.s_name ELSE {1}.s_name END"


def _csv(spark, sf) -> str:
    path = f"{Stage(spark, 'csv').root}/rows"
    RT.clean_text(spark, sf).drop("match_id").write.option("header", True).csv(path)
    return path


# Every raw column in SQL; texts that stand for a missing value are NULL after the scan.
_RAW = {
    **{c: f"'{v}'" for c, v in V.CONSTANTS.items()},
    "season": "CASE WHEN season_year % 2 = 0 THEN CAST(season_year AS VARCHAR) ELSE season_year || '/' || lpad(CAST((season_year+1)%100 AS VARCHAR), 2, '0') END",
    "match_number": "CASE WHEN NOT is_playoff THEN CAST(m.match_id AS VARCHAR) END", "date": "date_raw",
    "city": "CASE WHEN venue_id % 5 = 0 THEN 'Unknown' ELSE venue || ' City' END",
    "venue": "CASE WHEN venue_id % 2 = 1 AND m.match_id % 2 = 1 THEN lower(venue) ELSE venue END",
    "team1": _OLD.format("team1", "a"), "team2": _OLD.format("team2", "b"),
    **{c: f"CASE {c} WHEN team1 THEN {_OLD.format('team1', 'a')} WHEN team2 THEN {_OLD.format('team2', 'b')} END" for c in ("toss_winner", "winner")},
    "player_of_match": "'P' || best.player", "match_referee": "CAST(NULL AS VARCHAR)", "tv_umpire": "CAST(NULL AS VARCHAR)",
    "reserve_umpire": "CAST(NULL AS VARCHAR)", "team1_players": "qa.names", "team2_players": "qb.names",
}
_SQUAD_TEXT = "sq AS (SELECT match_id, team, string_agg('P' || player, ', ' ORDER BY slot_no) AS names FROM players GROUP BY 1, 2)"


@query(
    "csv_round_trip",
    sql(
        "SELECT " + ", ".join(f"{_RAW.get(c, f'CAST({c} AS VARCHAR)')} AS {c}" for c in V.RAW_COLUMNS)
        + """ FROM m JOIN supplier a ON a.s_suppkey = team1 JOIN supplier b ON b.s_suppkey = team2 LEFT JOIN best ON best.match_id = m.match_id
        LEFT JOIN sq qa ON qa.match_id = m.match_id AND qa.team = team1 LEFT JOIN sq qb ON qb.match_id = m.match_id AND qb.team = team2""",
        POTM, SQUADS, _SQUAD_TEXT,
    ),
)
def csv_round_trip(spark, sf):
    """All contests as text files, all columns read back through the guards as text."""
    return out(FI.read_raw(spark, _csv(spark, sf), max_bytes=1 << 40))


@query(
    "source_guards",
    sql(
        """SELECT c[1] AS "case", CAST(c[2] AS BIGINT) AS refused, (SELECT count(*) FROM m) AS rows FROM (SELECT unnest([row('accepted', 0), row('other suffix', 1),
        row('too large', 1), row('missing path', 1), row('exact columns', 0), row('extra column', 1), row('missing column', 1)]) AS c)"""
    ),
)
def source_guards(spark, sf):
    path = _csv(spark, sf)
    raw = FI.read_raw(spark, path)
    cases = {
        "accepted": _refused(FI.guard_files, spark, path), "other suffix": _refused(FI.guard_files, spark, path, ".txt"),
        "too large": _refused(FI.guard_files, spark, path, ".csv", 1), "missing path": _refused(FI.guard_files, spark, f"{path}-none"),
        "exact columns": _refused(V.check_columns, raw.columns), "extra column": _refused(V.check_columns, [*raw.columns, "match_id"]),
        "missing column": _refused(V.check_columns, raw.columns[1:]),
    }
    return out(_with_cases(raw.agg(count_rows().alias("rows")), cases, "case"))


@query(
    "strict_validation",
    sql(
        """SELECT 'clean' AS input, CAST(count(*) FILTER (NOT is_playoff AND match_id < 1) > 0 AS BIGINT) AS refused, count(*) FILTER (is_playoff OR match_id >= 1) AS rows FROM m
        UNION ALL SELECT 'faulty', CAST(count(*) FILTER (len(reasons) > 0) > 0 AS BIGINT), count(*) FILTER (len(reasons) = 0) FROM cr""",
        CHECKED,
    ),
)
def strict_validation(spark, sf):
    """Strict mode over rows with and without planted faults; ``rows`` are the valid ones. A number below one is a fault of its own."""
    parts = []
    for name, raw in (("clean", RT.clean_text(spark, sf)), ("faulty", RT.raw_text(spark, sf))):
        refused = _refused(V.validate, raw, RT.CONTRACT, "strict", ["match_id"])
        valid, _ = V.validate(raw, RT.CONTRACT, "lenient", ["match_id"])
        parts.append(valid.agg(count_rows().alias("rows")).select(F.lit(name).alias("input"), F.lit(refused).alias("refused"), "rows"))
    return out(ST.violations(parts))


@query(
    "file_fingerprint",
    sql("SELECT CAST(1 AS BIGINT) AS same_again, CAST(1 AS BIGINT) AS same_checked, CAST(1 AS BIGINT) AS change_refused, count(*) AS rows FROM m"),
)
def file_fingerprint(spark, sf):
    """The fingerprint of written files: equal when read again, refused after more rows arrive."""
    path = f"{Stage(spark, 'print').root}/rows"
    m = _m(spark, sf)
    m.write.parquet(path)
    first = FI.fingerprint(spark, path, "*.parquet")
    same, checked = FI.fingerprint(spark, path, "*.parquet") == first, _refused(FI.check_fingerprint, spark, path, first, "*.parquet")
    rows = Stage(spark, "print").write(spark.read.parquet(path).agg(count_rows().alias("rows")), "rows")
    m.where("season_year = 1997").write.mode("append").parquet(path)
    changed = _refused(FI.check_fingerprint, spark, path, first, "*.parquet")
    return out(rows.select(F.lit(same).alias("same_again"), F.lit(1 - checked).alias("same_checked"), F.lit(changed).alias("change_refused"), "rows"))


@query(
    "leak_guard",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column, CAST({r} AS BIGINT) AS refused, count({c}) AS known FROM m"
            for c, r in {
                "winner": 1, "margin_value": 1, "team1_runs": 1, "bat_first_won": 1, "toss_winner_won": 1, "dls_flag": 1, "season_champion": 1,
                "is_playoff": 0, "impact_era": 0,
            }.items()
        )
    ),
)
def leak_guard(spark, sf):
    """Which contest columns a model before the toss may read, and how many rows know them."""
    cols = ["winner", "margin_value", "team1_runs", "bat_first_won", "toss_winner_won", "dls_flag", "season_champion", "is_playoff", "impact_era"]
    known = _m(spark, sf).agg(*[F.count(c).alias(c) for c in cols])
    items = [F.struct(F.lit(c).alias("column"), F.lit(_refused(A.guard_inputs, [c], "pre_toss")).alias("refused"), F.col(c).alias("known")) for c in cols]
    return out(known.select(F.explode(F.array(*items)).alias("s")).select("s.*"))


# -- sinks ------------------------------------------------------------------------------------


@query("partitioned_sink", sql("SELECT league, season_year, count(*) AS rows, CAST(sum(match_id) AS BIGINT) AS ids FROM m GROUP BY 1, 2"))
def partitioned_sink(spark, sf):
    path = f"{Stage(spark, 'sink').root}/matches"
    FI.write_table(_m(spark, sf), path, ["league", "season_year"])
    back = spark.read.parquet(path)
    g = back.groupBy(*[F.col(c).cast("long").alias(c) for c in ("league", "season_year")]).agg(count_rows().alias("rows"), id_sum("match_id").alias("ids"))
    return exact_sums(g, "sink", "ids")


@query("feature_sink", fsql(f"SELECT match_id, CAST(1 AS BIGINT) AS builds, {q6('form10_diff')} AS form10_diff, {q6('h2h_edge')} AS h2h_edge FROM pf", *PF_CTES))
def feature_sink(spark, sf):
    """Features built and written at the first read, only read at the second."""
    path, builds = f"{Stage(spark, 'sink').root}/features", []

    def build():
        builds.append(path)
        return S.stored_features(spark, sf)

    FI.read_or_build(spark, path, build)
    back = FI.read_or_build(spark, path, build)
    return out(back.select("match_id", F.lit(len(builds)).alias("builds"), "form10_diff", "h2h_edge"))


@query("quarantine_sink", sql("SELECT match_id, array_to_string(reasons, '; ') AS reason FROM cr WHERE len(reasons) > 0", CHECKED))
def quarantine_sink(spark, sf):
    """Rejected rows written as text with their reasons, and read back."""
    path = f"{Stage(spark, 'sink').root}/rejected"
    _, bad = V.validate(RT.raw_text(spark, sf), RT.CONTRACT, "lenient", ["match_id"])
    FI.write_quarantine(bad, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return out(back.select(F.col("match_id").cast("long").alias("match_id"), "reason"))


@query(
    "report_sink",
    sql(
        """SELECT 'sides' AS section, team, season_year AS key, count(*) AS n, count(*) FILTER (won) AS wins FROM long GROUP BY team, season_year
        UNION ALL SELECT 'pairs', team, opponent, count(*), count(*) FILTER (won) FROM long GROUP BY team, opponent""",
        LONG,
    ),
)
def report_sink(spark, sf):
    """Two report sections written as JSON and read back."""
    path, m = f"{Stage(spark, 'sink').root}/report", _m(spark, sf)
    FI.write_report({"sides": ST.team_season_summary(m), "pairs": ST.head_to_head_all(m)}, path)
    sides, pairs = spark.read.json(f"{path}/sides"), spark.read.json(f"{path}/pairs")
    sides = sides.select(F.lit("sides").alias("section"), "team", F.col("season_year").alias("key"), F.col("matches").alias("n"), "wins")
    return out(sides.unionByName(pairs.select(F.lit("pairs").alias("section"), "team", F.col("opponent").alias("key"), F.col("meetings").alias("n"), "wins")))


# -- logs and reads ---------------------------------------------------------------------------

_P = "('0x' || substr(md5(CAST(request_id AS VARCHAR)), 1, 6))::BIGINT/16777216.0e0"
_LOG = f"""
lg AS (SELECT CASE WHEN toss_winner IS NOT NULL AND toss_decision IS NOT NULL THEN 'post_toss' ELSE 'pre_toss' END AS tier, team_a, team_b, venue_id, stage,
         CASE WHEN toss_winner IS NOT NULL AND toss_decision IS NOT NULL THEN '{{"winner":' || toss_winner || ',"decision":"' || toss_decision || '"}}' END AS toss_json,
         {q6(_P)} AS p_a FROM rc WHERE reasons = '')"""
_LOG_COLUMNS = ("tier", "team_a", "team_b", "venue_id", "stage", "toss_json", "p_a")


def _logged(spark, sf) -> str:
    """All valid requests under a hash as the probability, logged."""
    path = f"{Stage(spark, 'log').root}/predictions"
    p = F.conv(F.substring(F.md5(F.col("request_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    ok = MO.checked_requests(spark, sf).where("size(reasons) = 0")
    ST.log_predictions(ok.select("*", SC.tier().alias("tier"), F.lit("hash").alias("run_id"), p.alias("p_a")), path)
    return path


@query("prediction_log", sql(f"SELECT {', '.join(_LOG_COLUMNS)} FROM lg", MO.REQ, _LOG))
def prediction_log(spark, sf):
    return out(spark.read.parquet(_logged(spark, sf)), *_LOG_COLUMNS)


@query(
    "latest_predictions",
    sql(f"SELECT {', '.join(_LOG_COLUMNS)} FROM lg ORDER BY team_a, team_b, venue_id, stage, toss_json NULLS FIRST, p_a LIMIT 50", MO.REQ, _LOG),
)
def latest_predictions(spark, sf):
    """The latest fifty of the log; rows of one batch in order of their columns."""
    return out(ST.latest_predictions(spark, _logged(spark, sf)), *_LOG_COLUMNS)


@query(
    "model_runs",
    """SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN count(*) * 10 ELSE count(*) END AS n FROM events
    WHERE user_id % 5 <> 0 OR user_id % 3 = 0 GROUP BY user_id""",
)
def model_runs(spark, sf):
    """Runs recorded over earlier ones: a third of them again, some of those for the first time."""
    runs = S.table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(count_rows().alias("n"))
    first = ST.record_run(None, runs.where("run_id % 5 <> 0"))
    return out(ST.record_run(first, runs.where("run_id % 3 = 0").selectExpr("run_id", "n * 10 AS n")))


@query(
    "repository_side_reads",
    sql(
        """SELECT 'squad' AS read, team AS key, player AS value FROM players WHERE match_id = (SELECT max(match_id) FROM m)
        UNION ALL SELECT 'summary', season_year, count(*) FROM long WHERE team = 5 GROUP BY season_year""",
        LONG, SQUADS,
    ),
)
def repository_side_reads(spark, sf):
    """The squads of the last contest and the seasons of one side, by bound parameters."""
    t = S.stored(spark, sf)
    ST.register_views(spark, t["matches"], t["players"])
    last = t["matches"].agg(F.max("match_id")).first()[0]
    squad = ST.squads_of_match(spark, last if last is not None else -1).select(F.lit("squad").alias("read"), F.col("team").alias("key"), F.expr("CAST(player AS bigint)").alias("value"))
    seasons = ST.summary_of_team(spark, 5).select(F.lit("summary").alias("read"), F.col("season_year").alias("key"), F.col("matches").alias("value"))
    return out(squad.unionByName(seasons))


@query(
    "appended_rows",
    sql(
        """SELECT DISTINCT date_raw AS date, least(team1, team2) AS a, greatest(team1, team2) AS b FROM m WHERE season_year >= 1999
        EXCEPT SELECT date_raw, least(team1, team2), greatest(team1, team2) FROM m WHERE season_year <= 1999"""
    ),
)
def appended_rows(spark, sf):
    """The contests that an upload of the later seasons adds to the earlier ones."""
    m = _m(spark, sf).selectExpr("season_year", "date_raw AS date", "team1", "team2")
    fresh = AP.new_rows(m.where("season_year <= 1999"), m.where("season_year >= 1999"))
    return out(fresh.selectExpr("date", "least(team1, team2) AS a", "greatest(team1, team2) AS b"))


# -- scenarios and summary --------------------------------------------------------------------


@query(
    "ordered_pair_grid",
    """WITH t AS (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10)
    SELECT a.k || '-' || b.k AS pair, a.k AS team_a, b.k AS team_b, a.v AS venue_id, '2001-01-01' AS date, 'league' AS stage FROM t a JOIN t b ON a.k <> b.k""",
)
def ordered_pair_grid(spark, sf):
    """Requests for every ordered pair of a short list: the ten sides with the highest balance."""
    top = S.table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).collect()
    grid = SC.pair_grid(C.primary_home(RT.knowledge(spark, sf).spells, 2000), [r.s_suppkey for r in top], 0, "2001-01-01")
    return out(grid, "pair", "team_a", "team_b", "venue_id", "date", "stage")


@query(
    "default_dates",
    sql("SELECT match_id AS request_id, strftime(CASE WHEN match_id % 61 = 0 THEN (SELECT max(date) FROM m) + 1 ELSE date END, '%Y-%m-%d') AS date FROM m"),
)
def default_dates(spark, sf):
    """Requests without a date are for the day after the last contest."""
    m = _m(spark, sf)
    req = m.selectExpr("match_id AS request_id", "CASE WHEN match_id % 61 <> 0 THEN CAST(date AS string) END AS date")
    return out(SC.with_default_date(req, m), "request_id", "date")


#: Sections of the summary, the query with the same rows, and the columns that are no numbers and those that are.
_SECTIONS = {
    "kpis": ("kpis", "first_date last_date", "matches decided champion sides places"),
    "team_table": ("team_table", "", "team seasons matches wins losses no_decision win_pct ci_low ci_high titles finals best_season worst_season"),
    "season_win_pct": ("season_win_pct", "", "season_year team matches decided wins win_pct"),
    "head_to_head": ("head_to_head", "", "team opponent meetings wins win_pct"),
    "toss_by_venue": ("toss_by_venue", "", "venue_id n rate ci_low ci_high p_value p_holm"),
    "field_first": ("field_first_share", "", "season_year successes n rate ci_low ci_high"),
    "venues": (
        "venue_profiles", "venue", "venue_id matches decided first_season last_season avg_first_innings avg_first_innings_shrunk bat_first_win_rate"
        " bat_first_win_rate_shrunk chase_win_rate_shrunk field_share",
    ),
    "scoring": ("scoring_by_season", "", "season_year matches mean_first_innings median_first_innings share_200_plus max_first_innings"),
    "margins": ("margin_summary", "margin_type", "count mean std min p25 p50 p75 max"),
    "continuity": ("squad_continuity", "", "team season_year mean_jaccard transitions"),
    "officials": ("officials_table", "", "official matches first last bat_first_win_rate"),
}


def _summary_sql(section: str) -> str:
    name, texts, numbers = _SECTIONS[section]
    cells = [f"row('{c}', count({q}), '')" for c in texts.split() for q in (f'"{c}"',)]
    cells += [f"row('{c}', count({q}), coalesce(CAST(sum(CAST({q} AS DECIMAL(38,6))) AS VARCHAR), ''))" for c in numbers.split() for q in (f'"{c}"',)]
    return f"SELECT '{section}' AS section, rows, c[1] AS \"column\", c[2] AS known, c[3] AS total FROM (SELECT count(*) AS rows, unnest([{', '.join(cells)}]) AS c FROM ({RE.SQL[name]}))"


@query("headline_summary", " UNION ALL ".join(map(_summary_sql, _SECTIONS)))
def headline_summary(spark, sf):
    """Every column of every section of the summary that has its own query: rows, known values and their exact sum."""
    t = S.stored(spark, sf)
    sections, parts = analytics_summary(t["matches"], t["players"]), []
    for s, (_, texts, numbers) in _SECTIONS.items():
        rows = out(sections[s])
        total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,6)")).cast("string"), F.lit(""))
        cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("known"), F.lit("").alias("total")) for c in texts.split()]
        cells += [F.struct(F.lit(c).alias("column"), F.count(c).alias("known"), total(c).alias("total")) for c in numbers.split()]
        one = rows.agg(count_rows().alias("rows"), F.array(*cells).alias("c"))
        parts.append(one.select(F.lit(s).alias("section"), "rows", F.explode("c").alias("c")).select("section", "rows", "c.*"))
    return out(ST.violations(parts))
