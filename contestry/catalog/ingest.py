"""Registered queries: sources, validation, canonicalisation, dimensions, store, append."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from contestry.catalog.base import LONG, POTM, SQUADS, exact_sums, id_sum, out, q6, sql
from contestry.functions.text import safe_cell, split_names
from contestry.operators import append as AP
from contestry.operators import cleaning as C
from contestry.operators import store as ST
from contestry.operators import trends as T
from contestry.operators import validate as V
from contestry.operators import versions as VN
from contestry.operators.ordering import dense_sequence
from contestry.plans import canonical as P
from contestry.sources import contests as S
from contestry.sources import files as FI
from contestry.sources import rawtext as RT
from contestry.session import Stage

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


# -- sources ----------------------------------------------------------------------------------

_FORMULA = "substr({0},1,1) IN ('=','+','-','@',chr(9),chr(13))"


@query(
    "safe_export_cells",
    f"SELECT doc_id, md5(CASE WHEN {_FORMULA.format('text')} THEN '''' || text ELSE text END) AS cell,"
    f" CAST({_FORMULA.format('text')} AS BIGINT) AS quoted FROM documents",
)
def safe_export_cells(spark, sf):
    d = S.table(spark, sf, "documents")
    safe = safe_cell(F.col("text"))
    return out(d.select("doc_id", F.md5(safe.cast("binary")).alias("cell"), (safe != F.col("text")).alias("quoted")))


_H = "md5(CAST(event_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) || '|' || event_type)"


@query(
    "table_fingerprint",
    f"SELECT count(*) AS rows, CAST(sum(('0x' || substr({_H},1,8))::BIGINT) AS BIGINT) AS hash_a,"
    f" CAST(sum(('0x' || substr({_H},9,8))::BIGINT) AS BIGINT) AS hash_b FROM events",
)
def table_fingerprint(spark, sf):
    return out(FI.table_fingerprint(S.table(spark, sf, "events").select("event_id", "user_id", "event_type")))


@query(
    "union_sources",
    sql(
        "SELECT source_ord, count(*) AS rows, CAST(sum(match_id) AS BIGINT) AS ids FROM (SELECT match_id, 0 AS source_ord FROM m WHERE season_year <= 1999"
        " UNION ALL SELECT match_id, 1 FROM m WHERE season_year >= 1999) GROUP BY source_ord"
    ),
)
def union_sources(spark, sf):
    m = _m(spark, sf)
    u = FI.union_sources(m.where("season_year <= 1999"), m.where("season_year >= 1999"))
    g = u.groupBy(F.col("_source_ord").cast("long").alias("source_ord")).agg(F.count(F.lit(1)).alias("rows"), id_sum("match_id").alias("ids"))
    return exact_sums(g, "sources", "ids")


# -- validation -------------------------------------------------------------------------------

# Which planted fault a row carries, in SQL over the contest table.
_HIT = "(NOT is_playoff AND match_id % {0} = 0)"
_C = {n: _HIT.format(n) for n in (101, 103, 107, 109, 113, 127, 131, 137, 139, 149)}
_LABEL = "CASE WHEN season_year % 2 = 0 THEN CAST(season_year AS VARCHAR) ELSE season_year || '/' || lpad(CAST((season_year+1)%100 AS VARCHAR), 2, '0') END"
CHECKED = f"""
ck AS (SELECT *,
  list_filter([
    CASE WHEN NOT is_playoff AND match_id < 1 THEN 'schema:match_number:greater_than_or_equal_to(1)' END,
    CASE WHEN {_C[149]} THEN 'schema:date:str_matches(''^\\d{{2}}-\\d{{2}}-\\d{{4}}$'')' END,
    CASE WHEN {_C[101]} THEN 'schema:toss_decision:isin([''bat'', ''field''])' END,
    CASE WHEN {_C[139]} THEN 'schema:team1_runs:coerce_dtype(''int64'')' END,
    CASE WHEN NOT {_C[139]} AND team1_runs > 350 THEN 'schema:team1_runs:in_range(0, 350)' END,
    CASE WHEN team2_runs > 350 THEN 'schema:team2_runs:in_range(0, 350)' END,
    CASE WHEN win_by_runs > 300 THEN 'schema:win_by_runs:in_range(0, 300)' END,
    CASE WHEN {_C[137]} THEN 'schema:overs_limit:isin([20])' END], lambda x: x IS NOT NULL) AS s,
  list_filter([
    CASE WHEN {_C[113]} THEN 'rule:distinct_teams' END,
    CASE WHEN {_C[103]} OR ({_C[113]} AND toss_winner = team2) THEN 'rule:toss_winner_in_match' END,
    CASE WHEN winner IS NOT NULL AND NOT {_C[127]} AND {_C[113]} AND winner = team2 THEN 'rule:winner_in_match' END,
    CASE WHEN (winner IS NOT NULL AND NOT {_C[127]}) <> (result_type = 'complete') THEN 'rule:winner_iff_complete' END,
    CASE WHEN result_type <> 'tie' AND {_C[107]} THEN 'rule:wickets_le_10_unless_tie' END,
    CASE WHEN {_C[109]} AND NOT {_C[149]} THEN 'rule:valid_date' END,
    CASE WHEN {_C[131]} THEN 'rule:squad_size' END], lambda x: x IS NOT NULL) AS rr FROM m),
cr AS (SELECT *, CASE WHEN len(s) > 0 THEN s ELSE rr END AS reasons FROM ck)"""


@query("quarantine_reasons", sql("SELECT match_id, array_to_string(reasons, '; ') AS reason FROM cr WHERE len(reasons) > 0", CHECKED))
def quarantine_reasons(spark, sf):
    _, bad = V.split(V.with_reasons(RT.raw_text(spark, sf), RT.CONTRACT, ["match_id"]), ["match_id"])
    return out(bad, "match_id", "reason")


@query("rejection_histogram", sql("SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM cr) GROUP BY reason", CHECKED))
def rejection_histogram(spark, sf):
    return out(V.rejection_histogram(V.with_reasons(RT.raw_text(spark, sf), RT.CONTRACT, ["match_id"])))


@query(
    "valid_typed_rows",
    sql(
        f"""SELECT match_id, {_LABEL} AS season, CASE WHEN NOT is_playoff THEN CAST(match_id AS DOUBLE) END AS match_number, date_raw AS date, team1_runs, CASE WHEN {_C[107]} THEN 11 ELSE team1_wickets END AS team1_wickets,
        team2_runs, team2_wickets, win_by_runs, win_by_wickets, result_type, CAST(20 AS BIGINT) AS overs_limit, CAST(NULL AS VARCHAR) AS match_referee
        FROM cr WHERE len(reasons) = 0""",
        CHECKED,
    ),
)
def valid_typed_rows(spark, sf):
    valid, _ = V.split(V.with_reasons(RT.raw_text(spark, sf), RT.CONTRACT, ["match_id"]), ["match_id"])
    return out(
        valid, "match_id", "season", "match_number", "date", "team1_runs", "team1_wickets", "team2_runs", "team2_wickets",
        "win_by_runs", "win_by_wickets", "result_type", "overs_limit", "match_referee",
    )


# -- canonicalisation -------------------------------------------------------------------------

# Keys that two contests of a day can share make a fact apply to both, as the lists are keyed.
FACTS = """
pk AS (SELECT date_raw, least(team1,team2) AS lo, greatest(team1,team2) AS hi, bool_or(match_id % 97 = 0) AS dls, bool_or(voided) AS vd,
         min(CASE WHEN result_type='tie' THEN CAST(team1_runs - match_id % 3 AS DOUBLE) END) AS tied,
         min(CASE WHEN result_type='tie' THEN CASE WHEN match_id % 2 = 0 THEN n1.s_name ELSE n2.s_name END END) AS son
       FROM m JOIN supplier n1 ON n1.s_suppkey=team1 JOIN supplier n2 ON n2.s_suppkey=team2 GROUP BY 1, 2, 3),
sid AS (SELECT s_name, s_suppkey FROM supplier)"""
# Canonical table of the rows that pass validation, restated from the contest table.
CLEANED = """
cl AS (SELECT cr.*, pk.dls AS f_dls, pk.vd AS f_vd, pk.tied AS f_tied, sid.s_suppkey AS f_so,
         row_number() OVER (ORDER BY cr.date, CASE WHEN venue_id % 2 = 1 AND match_id % 2 = 1 THEN lower(venue) ELSE venue END, al1.t, al2.t) AS new_id
       FROM cr JOIN pk ON pk.date_raw=cr.date_raw AND pk.lo=least(team1,team2) AND pk.hi=greatest(team1,team2)
       LEFT JOIN sid ON sid.s_name = pk.son AND cr.result_type='tie'
       JOIN (SELECT match_id AS i, CASE WHEN season_year <= 1997 AND team1 % 3 = 0 THEN 'Old ' || s_name ELSE s_name END AS t FROM m JOIN supplier ON s_suppkey=team1) al1 ON al1.i=cr.match_id
       JOIN (SELECT match_id AS i, CASE WHEN season_year <= 1997 AND team2 % 3 = 0 THEN 'Old ' || s_name ELSE s_name END AS t FROM m JOIN supplier ON s_suppkey=team2) al2 ON al2.i=cr.match_id
       WHERE len(reasons) = 0)"""


def _clean(spark, sf):
    carry = ["match_id", "league"]
    checked = Stage(spark, "checked").write(V.with_reasons(RT.raw_text(spark, sf, ["league"]), RT.CONTRACT, carry), "rows")
    valid, _ = V.split(checked, carry)
    valid = valid.withColumnRenamed("match_id", "source_id")
    return P.clean(
        valid, RT.knowledge(spark, sf), RT.facts(spark, sf), S.ERA_FROM, season_keys=("league", "season_year"), special=None
    )


@query(
    "canonicalised_from_text",
    sql(
        f"""SELECT new_id AS match_id, match_id AS source_id, season_year, team1, team2, toss_winner, winner, venue_id, venue, venue || ' City' AS city, bat_first, margin_type, margin_value,
        {q6("CASE WHEN result_type='tie' THEN f_tied ELSE first_innings_runs END")} AS first_innings_runs,
        {q6("CASE WHEN result_type='tie' THEN f_tied ELSE second_innings_runs END")} AS second_innings_runs,
        CASE WHEN result_type='tie' THEN f_so END AS super_over_winner, CAST(f_vd AS BIGINT) AS voided, CAST(dls_heuristic OR f_dls AS BIGINT) AS dls_flag, st2 AS stage,
        max(CASE WHEN st2='final' THEN winner END) OVER (PARTITION BY league, season_year) AS season_champion, CAST(season_year = 1996 AS BIGINT) AS neutral_season
        FROM (SELECT *, CASE WHEN is_playoff THEN list_extract(['qualifier_1','eliminator','qualifier_2','final'],
                CAST(row_number() OVER (PARTITION BY league, season_year, is_playoff ORDER BY date, new_id) AS INT)) ELSE 'league' END AS st2 FROM cl)""",
        CHECKED, FACTS, CLEANED,
    ),
)
def canonicalised_from_text(spark, sf):
    return out(
        _clean(spark, sf), "match_id", "source_id", "season_year", "team1", "team2", "toss_winner", "winner", "venue_id", "venue", "city",
        "bat_first", "margin_type", "margin_value", "first_innings_runs", "second_innings_runs", "super_over_winner", "voided",
        "dls_flag", "stage", "season_champion", "neutral_season",
    )


@query(
    "fix_counts",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS fix, count(*) FILTER ({e}) AS rows FROM cl"
            for n, e in {
                "season_label_mapped": "season_year % 2 = 1", "venue_alias_canonicalised": "venue_id % 2 = 1 AND match_id % 2 = 1",
                "city_unknown_imputed": "venue_id % 5 = 0", "city_corrected": "FALSE",
                "tie_innings_corrected_super_over_removed": "result_type='tie'", "voided_flagged": "f_vd",
                "no_result_scores_excluded": "result_type='no result' OR f_vd", "dls_flag_heuristic": "dls_heuristic",
                "dls_flag_external": "f_dls", "dls_flag_total": "dls_heuristic OR f_dls", "stage_derived_playoff": "is_playoff",
            }.items()
        )
        + " UNION ALL SELECT 'team_alias_canonicalised', CAST(coalesce(sum(CAST(season_year <= 1997 AND team1 % 3 = 0 AS INT) + CAST(season_year <= 1997 AND team2 % 3 = 0 AS INT)), 0) AS BIGINT) FROM cl"
        " UNION ALL SELECT 'player_lists_parsed', 2 * count(*) FROM cl",
        CHECKED, FACTS, CLEANED,
    ),
)
def fix_counts(spark, sf):
    return out(P.fixes(_clean(spark, sf)))


@query(
    "fact_list_notes",
    sql(
        """SELECT 'n_matches' AS note, count(*) AS rows FROM cl UNION ALL SELECT 'n_decided', count(*) FILTER (is_decided) FROM cl
        UNION ALL SELECT 'super_over_records_unmatched', (SELECT count(*) FROM m WHERE result_type = 'tie') - count(*) FILTER (result_type = 'tie') FROM cl
        UNION ALL SELECT 'dls_external_unmatched', (SELECT count(*) FROM (SELECT DISTINCT date_raw, least(team1, team2), greatest(team1, team2) FROM m WHERE match_id % 97 = 0)) - count(*) FILTER (f_dls) FROM cl""",
        CHECKED, FACTS, CLEANED,
    ),
)
def fact_list_notes(spark, sf):
    """Contests, and entries of the verified lists that met none of the valid rows."""
    return out(P.notes(_clean(spark, sf), RT.knowledge(spark, sf), RT.facts(spark, sf)))


@query(
    "squads_from_text",
    sql(
        "SELECT cl.new_id AS match_id, p.team, 'P' || p.player AS player, p.slot_no FROM cl JOIN players p ON p.match_id = cl.match_id",
        CHECKED, FACTS, CLEANED, SQUADS,
    ),
)
def squads_from_text(spark, sf):
    return out(C.squads_long(_clean(spark, sf)))


@query("season_years", sql(f"SELECT {_LABEL} AS season_raw, CAST(min(year(date)) AS BIGINT) AS season_year FROM m GROUP BY 1"))
def season_years(spark, sf):
    m = RT.clean_text(spark, sf).select(F.col("season").alias("season_raw"), F.to_date("date", "dd-MM-yyyy").alias("date"))
    return out(C.season_years(m))


@query("dense_match_ids", sql("SELECT match_id AS source_id, row_number() OVER (ORDER BY date, match_id) AS match_id FROM m"))
def dense_match_ids(spark, sf):
    m = _m(spark, sf).select(F.col("match_id").alias("source_id"), "day")
    return out(C.with_match_id(m, ["source_id"]), "source_id", "match_id")


@query(
    "unmapped_teams",
    sql(
        "SELECT DISTINCT 'Old ' || s_name AS raw, season_year+2 AS year FROM (SELECT season_year, unnest([team1, team2]) AS team FROM m)"
        " JOIN supplier ON s_suppkey=team WHERE season_year <= 1997 AND team % 3 = 0 AND season_year+2 > 1997"
    ),
)
def unmapped_teams(spark, sf):
    """Aliases of either side two seasons after their use: the expired ones."""
    t = RT.clean_text(spark, sf).select("match_id", "team1", "team2").join(_m(spark, sf).select("match_id", "season_year"), "match_id")
    t = t.select((F.col("season_year") + 2).alias("season_year"), F.explode(F.array("team1", "team2")).alias("side"))
    return out(C.unmapped_teams(t, RT.knowledge(spark, sf).team_alias, "side"))


@query(
    "home_flags",
    sql(
        """SELECT match_id, team, CAST(season_year <> 1996 AND (venue_id = s_nationkey OR (season_year >= 1998 AND venue_id = (s_nationkey+1)%25)) AS BIGINT) AS is_home
        FROM long JOIN supplier ON s_suppkey = team""",
        LONG,
    ),
)
def home_flags(spark, sf):
    k = RT.knowledge(spark, sf)
    return out(C.home_flags(_m(spark, sf), k.spells, k.neutral))


@query("primary_home", "SELECT s_suppkey AS team, CAST(s_nationkey AS BIGINT) AS venue_id FROM supplier")
def primary_home(spark, sf):
    return out(C.primary_home(RT.knowledge(spark, sf).spells, 1999))


@query(
    "knowledge_reference_errors",
    "SELECT 'reference' AS kind, 'home.venue_id' AS \"table\", CAST(c_custkey + 25 AS VARCHAR) AS key FROM customer WHERE c_custkey + 25 NOT IN (SELECT n_nationkey FROM nation)",
)
def knowledge_reference_errors(spark, sf):
    k = RT.knowledge(spark, sf)
    homes = S.table(spark, sf, "customer").select((F.col("c_custkey") + 25).alias("venue_id"))
    bad = ST.check_reference(homes, "home", "venue_id", k.venues, "venue_id")
    return out(k.reference_errors().unionByName(bad))


@query("split_squad_lists", "SELECT doc_id, len(list_filter(string_split(text, ', '), lambda x: trim(x) <> '')) AS parts FROM documents")
def split_squad_lists(spark, sf):
    return out(S.table(spark, sf, "documents").select("doc_id", F.size(split_names(F.col("text"))).alias("parts")))


@query(
    "duplicate_players",
    "SELECT l_orderkey AS match_id, l_suppkey % 2 AS team, l_partkey % 7 AS player FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def duplicate_players(spark, sf):
    li = S.table(spark, sf, "lineitem").selectExpr("l_orderkey AS match_id", "l_suppkey % 2 AS team", "l_partkey % 7 AS player")
    return out(C.duplicate_players(li))


# -- store ------------------------------------------------------------------------------------


@query(
    "dimension_upsert",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name FROM customer"
    " WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def dimension_upsert(spark, sf):
    c = S.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return out(ST.upsert(c.where("id % 2 = 0"), c.where("id % 3 = 0").selectExpr("id", "concat(upper(name), '!') AS name"), ["id"]))


@query(
    "stable_name_ids",
    "SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE (SELECT max(c_custkey) FROM customer WHERE c_custkey % 4 = 0)"
    " + count(*) FILTER (c_custkey % 4 <> 0) OVER (ORDER BY c_name) END AS id FROM customer",
)
def stable_name_ids(spark, sf):
    c = S.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return out(ST.ensure_names(c.where("id % 4 = 0"), c))


@query(
    "fact_refresh",
    sql("SELECT match_id, team1 AS team1_id, team2 AS team2_id, winner AS winner_id, venue_id FROM m"),
)
def fact_refresh(spark, sf):
    """Names back to ids through the dimensions."""
    k = RT.knowledge(spark, sf)
    teams = k.teams.select("name", "team_id")
    m = _m(spark, sf)
    for c in ("team1", "team2", "winner"):
        m = m.join(teams.select(F.col("team_id").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    named = m.selectExpr("match_id", "team1_name AS team1", "team2_name AS team2", "winner_name AS winner", "venue")
    look = {c: (k.teams, "name", "team_id") for c in ("team1", "team2", "winner")}
    return out(ST.resolve(named, {**look, "venue": (k.venues, "name", "venue_id")}).withColumnRenamed("venue_id", "venue_id"))


_PEOPLE = """
pd AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (
         SELECT 'P' || p.player AS name FROM players p JOIN cl ON cl.match_id = p.match_id UNION SELECT 'P' || b.player FROM best b JOIN cl ON cl.match_id = b.match_id)),
od AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT CAST(umpire1 AS VARCHAR) AS name FROM cl UNION SELECT CAST(umpire2 AS VARCHAR) FROM cl))"""


def _people(spark, sf):
    m = Stage(spark, "people").write(_clean(spark, sf), "matches")
    return ST.refresh_people(m, C.squads_long(m))


@query(
    "fact_people_refresh",
    sql(
        """SELECT new_id AS match_id, cl.match_id AS source_id, team1, team2, pd.id AS player_of_match_id, CAST(NULL AS BIGINT) AS match_referee_id,
        u1.id AS umpire1_id, u2.id AS umpire2_id, CAST(NULL AS BIGINT) AS tv_umpire_id, CAST(NULL AS BIGINT) AS reserve_umpire_id
        FROM cl LEFT JOIN best b ON b.match_id = cl.match_id LEFT JOIN pd ON pd.name = 'P' || b.player
        JOIN od u1 ON u1.name = CAST(umpire1 AS VARCHAR) JOIN od u2 ON u2.name = CAST(umpire2 AS VARCHAR)""",
        CHECKED, FACTS, CLEANED, SQUADS, POTM, _PEOPLE,
    ),
)
def fact_people_refresh(spark, sf):
    """Contests with the ids of the awarded player and of all five officials."""
    ids = [f"{c}_id" for c in ("player_of_match", *ST.OFFICIALS)]
    return out(_people(spark, sf)["contests"], "match_id", "source_id", "team1", "team2", *ids)


@query(
    "squad_refresh",
    sql(
        "SELECT cl.new_id AS match_id, p.team, pd.id AS player_id, p.slot_no FROM cl JOIN players p ON p.match_id = cl.match_id JOIN pd ON pd.name = 'P' || p.player",
        CHECKED, FACTS, CLEANED, SQUADS, POTM, _PEOPLE,
    ),
)
def squad_refresh(spark, sf):
    return out(_people(spark, sf)["squads"])


@query(
    "season_dimension",
    sql(f"SELECT league, season_year, arg_min({_LABEL}, date) AS label, count(*) AS matches, max(season_champion) AS champion FROM m GROUP BY 1, 2"),
)
def season_dimension(spark, sf):
    label = F.expr("CASE WHEN season_year % 2 = 0 THEN CAST(season_year AS string) ELSE concat(season_year, '/', lpad((season_year + 1) % 100, 2, '0')) END")
    return out(ST.season_dimension(_m(spark, sf).withColumn("season_raw", label), ["league", "season_year"]))


@query(
    "integrity_violations",
    sql(
        """SELECT 'unique' AS kind, 'lineitem' AS "table", l_orderkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        UNION ALL SELECT 'check', 'match.no_home_side', CAST(match_id AS VARCHAR) FROM m WHERE team1_home AND team2_home""",
    ),
)
def integrity_violations(spark, sf):
    k, m = RT.knowledge(spark, sf), _m(spark, sf)
    return out(
        ST.violations(
            [
                ST.check_unique(m, "match", ["match_id"]),
                ST.check_unique(S.table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]),
                ST.check_reference(m, "match", "winner", k.teams, "team_id"),
                ST.check_reference(m, "match", "venue_id", k.venues, "venue_id"),
                ST.check_rows(m, "match", "distinct_sides", "team1 <> team2", "match_id"),
                ST.check_rows(m, "match", "no_home_side", "NOT (team1_home AND team2_home)", "match_id"),
            ]
        )
    )


@query(
    "table_counts",
    sql("SELECT 'match' AS \"table\", count(*) AS rows FROM m UNION ALL SELECT 'match_player', count(*) FROM players UNION ALL SELECT 'team', count(*) FROM supplier", SQUADS),
)
def table_counts(spark, sf):
    t = S.stored(spark, sf)
    return out(ST.table_counts({"match": t["matches"], "match_player": t["players"], "team": RT.knowledge(spark, sf).teams}))


@query(
    "team_season_summary_view",
    sql(
        "SELECT season_year, team, count(*) AS matches, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses,"
        " count(*) FILTER (NOT is_decided) AS no_decision FROM long GROUP BY 1, 2",
        LONG,
    ),
)
def team_season_summary_view(spark, sf):
    return out(ST.team_season_summary(_m(spark, sf)))


@query(
    "head_to_head_view",
    sql("SELECT team, opponent, count(*) AS meetings, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM long GROUP BY 1, 2", LONG),
)
def head_to_head_view(spark, sf):
    return out(ST.head_to_head_all(_m(spark, sf)))


@query(
    "repository_reads",
    sql(
        "SELECT 'season' AS read, match_id FROM m WHERE season_year = 1997 UNION ALL SELECT 'team', match_id FROM m WHERE team1 = 5 OR team2 = 5"
        " UNION ALL SELECT 'injection', match_id FROM m WHERE FALSE"
    ),
)
def repository_reads(spark, sf):
    t = S.stored(spark, sf)
    ST.register_views(spark, t["matches"], t["players"])
    reads = {
        "season": ST.matches_of_season(spark, 1997), "team": ST.matches_of_team(spark, 5),
        "injection": spark.sql("SELECT * FROM contest WHERE venue = :v", args={"v": "x' OR '1'='1"}),
    }
    parts = [d.select(F.lit(n).alias("read"), "match_id") for n, d in reads.items()]
    return out(ST.violations(parts))


# -- append -----------------------------------------------------------------------------------

_UPLOAD = """
up AS (SELECT date_raw, least(team1,team2) AS a, greatest(team1,team2) AS b FROM m WHERE season_year >= 1999
       UNION ALL SELECT date_raw, least(team1,team2), greatest(team1,team2) FROM m WHERE season_year >= 1999 AND match_id % 3 = 0)"""


@query(
    "append_counts",
    sql(
        """SELECT (SELECT count(*) FROM up) AS rows_received, n AS rows_new, (SELECT count(*) FROM up) - n AS rows_duplicate FROM (
        SELECT count(*) AS n FROM (SELECT DISTINCT date_raw, a, b FROM up EXCEPT
          SELECT date_raw, least(team1,team2), greatest(team1,team2) FROM m WHERE season_year <= 1999))""",
        _UPLOAD,
    ),
)
def append_counts(spark, sf):
    """The later seasons uploaded onto the earlier ones, with a third of the rows sent twice, sides swapped."""
    m = _m(spark, sf).select("match_id", "season_year")
    raw = RT.clean_text(spark, sf).join(m, "match_id")
    cols = V.RAW_COLUMNS
    upload = raw.where("season_year >= 1999")
    other = {"team1": "team2 AS team1", "team2": "team1 AS team2"}
    swapped = upload.where("match_id % 3 = 0").selectExpr(*[other.get(c, c) for c in cols])
    upload = upload.select(*cols).unionByName(swapped)
    fresh = AP.new_rows(raw.where("season_year <= 1999").select(*cols), upload)
    return out(AP.append_counts(upload, fresh))


_NAMED = "CASE WHEN season_year <= 1997 AND {0} % 3 = 0 THEN 'Old ' || {1}.s_name ELSE {1}.s_name END"


@query(
    "append_two_writers",
    sql(
        f"""SELECT DISTINCT date, least(a, b) AS a, greatest(a, b) AS b FROM (
          SELECT date_raw AS date, {_NAMED.format('team1', 'x')} AS a, {_NAMED.format('team2', 'y')} AS b
          FROM m JOIN supplier x ON x.s_suppkey = team1 JOIN supplier y ON y.s_suppkey = team2 WHERE is_playoff OR match_id >= 1)"""
    ),
)
def append_two_writers(spark, sf):
    """The stored contests after two writers append overlapping seasons at the same time, and a compaction."""
    stage = Stage(spark, "writers")
    base = f"{stage.root}/store"
    raw = RT.clean_text(spark, sf, ["season_year"]).where("NOT coalesce(try_cast(match_number AS double) < 1, false)")
    raw = stage.write(raw, "raw")
    upload = lambda where: raw.where(where).select(*V.RAW_COLUMNS)
    put = lambda rows: AP.process_append(spark, base, rows, RT.CONTRACT, dry_run=False)
    put(upload("season_year <= 1996"))
    with ThreadPoolExecutor(2) as pool:
        for job in [pool.submit(put, upload(w)) for w in ("season_year <= 1999", "season_year >= 1997")]:
            job.result()
    VN.compact(spark, base)
    return out(AP.read_current(spark, base).selectExpr("date", "least(team1, team2) AS a", "greatest(team1, team2) AS b"))
