"""The contest table written back as raw text rows, with faults planted by key, and the dimension
tables that go with it. Every row derives from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.operators.validate import CONSTANTS, RAW_COLUMNS, Contract
from contestry.plans.canonical import Facts, Knowledge
from contestry.sources.contests import SUPER_OVER_WINNER, TIED_SCORE, stored, table

CONTRACT = Contract(squad=(1, 13))

ALIAS = "CASE WHEN season_year <= 1997 AND {id} % 3 = 0 THEN concat('Old ', {name}) ELSE {name} END"
# Planted faults: (modulus, column, SQL of the wrong text). Playoffs stay clean.
FAULTS = (
    (101, "toss_decision", "'bowl'"), (103, "toss_winner", "'Somebody Else'"), (107, "team1_wickets", "'11'"),
    (109, "date", "'31-02-2020'"), (113, "team2", "team1"), (127, "winner", "'None'"),
    (131, "team1_players", "'a, b, c, d, e, f, g, h, i, j, k, l, m, n'"), (137, "overs_limit", "'50'"),
    (139, "team1_runs", "'x'"), (149, "date", "'2020-01-01'"),
)


def clean_text(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """(match_id, ``keep``, raw columns): faultless text rows of all contests; ``keep`` names columns of the contests."""
    m = stored(spark, sf_dir)["listed"]
    names = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS _id", "s_name AS _name")
    for i in (1, 2):
        m = m.join(names.selectExpr(f"_id AS team{i}", f"_name AS name{i}"), f"team{i}")
        m = m.withColumn(f"squad{i}", F.expr(f"array_join(transform(team{i}_squad, x -> concat('P', x)), ', ')"))
    m = m.selectExpr("*", f"{ALIAS.format(id='team1', name='name1')} AS t1", f"{ALIAS.format(id='team2', name='name2')} AS t2")
    text = {
        "season": "CASE WHEN season_year % 2 = 0 THEN CAST(season_year AS string) ELSE concat(season_year, '/', lpad((season_year + 1) % 100, 2, '0')) END",
        "match_number": "CASE WHEN is_playoff THEN 'N/A' ELSE CAST(match_id AS string) END",
        "date": "date_raw",
        "city": "CASE WHEN venue_id % 5 = 0 THEN 'Unknown' ELSE concat(venue, ' City') END",
        "venue": "CASE WHEN venue_id % 2 = 1 AND match_id % 2 = 1 THEN lower(venue) ELSE venue END",
        "team1": "t1", "team2": "t2",
        "toss_winner": "CASE WHEN toss_winner = team1 THEN t1 ELSE t2 END",
        "winner": "CASE WHEN winner = team1 THEN t1 WHEN winner = team2 THEN t2 ELSE 'None' END",
        "player_of_match": "coalesce(concat('P', player_of_match), 'None')",
        "match_referee": "'None'", "tv_umpire": "''", "reserve_umpire": "'NaN'",
        "umpire1": "CAST(umpire1 AS string)", "umpire2": "CAST(umpire2 AS string)",
        "team1_players": "squad1", "team2_players": "squad2",
        **{k: f"'{v}'" for k, v in CONSTANTS.items()},
    }
    return m.selectExpr("match_id", *keep, *[f"CAST({text.get(c, c)} AS string) AS {c}" for c in RAW_COLUMNS])


def raw_text(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """The same rows with the planted faults."""
    wrong: dict[str, str] = {}
    for mod, col, sql in FAULTS:
        wrong[col] = f"CASE WHEN match_id % {mod} = 0 AND match_number <> 'N/A' THEN {sql} ELSE {wrong.get(col, col)} END"
    return clean_text(spark, sf_dir, keep).selectExpr("match_id", *keep, *[f"{wrong.get(c, c)} AS {c}" for c in RAW_COLUMNS])


def knowledge(spark: SparkSession, sf_dir: str) -> Knowledge:
    sup = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    alias = sup.selectExpr(
        "explode(CASE WHEN s_suppkey % 3 = 0 THEN array(struct(concat('Old ', s_name) AS alias, 0 AS valid_from, 1997 AS valid_to),"
        " struct(s_name AS alias, 1998 AS valid_from, 9999 AS valid_to)) ELSE array(struct(s_name AS alias, 0 AS valid_from, 9999 AS valid_to)) END) AS a",
        "s_suppkey AS team_id",
    ).select("a.*", "team_id")
    spells = sup.selectExpr(
        "s_suppkey AS team",
        "explode(array(struct(CAST(s_nationkey AS bigint) AS venue_id, 1 AS spell_no, 1 AS ordinal, 0 AS valid_from, 1997 AS valid_to),"
        " struct(CAST(s_nationkey AS bigint) AS venue_id, 2 AS spell_no, 1 AS ordinal, 1998 AS valid_from, 9999 AS valid_to),"
        " struct(CAST((s_nationkey + 1) % 25 AS bigint) AS venue_id, 2 AS spell_no, 2 AS ordinal, 1998 AS valid_from, 9999 AS valid_to))) AS s",
    ).select("team", "s.*")
    neutral = stored(spark, sf_dir)["matches"].where("season_year = 1996").select("season_year").distinct()
    return Knowledge(
        teams=sup.selectExpr("s_suppkey AS team_id", "s_name AS name", "concat('S', s_suppkey) AS short", "true AS active"),
        team_alias=alias,
        venues=nation.selectExpr("CAST(n_nationkey AS bigint) AS venue_id", "n_name AS name", "concat(n_name, ' City') AS city", "r_name AS country"),
        venue_alias=nation.selectExpr("explode(array(n_name, lower(n_name))) AS alias", "CAST(n_nationkey AS bigint) AS venue_id"),
        spells=spells,
        neutral=neutral,
    )


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """Fact lists that name the sides by their texts."""
    m = stored(spark, sf_dir)["matches"]
    names = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS _id", "s_name AS _name")
    for i in (1, 2):
        m = m.join(names.selectExpr(f"_id AS team{i}", f"_name AS name{i}"), f"team{i}")
    key = ["date_raw", "name1 AS team_a", "name2 AS team_b"]
    won = SUPER_OVER_WINNER.replace("team1", "name1").replace("team2", "name2")
    return Facts(
        super_overs=m.where("result_type = 'tie'").selectExpr(*key, f"{won} AS super_over_winner", f"{TIED_SCORE} AS regulation_score_tied"),
        dls=m.where("match_id % 97 = 0").selectExpr(*key),
        voided=m.where("voided").selectExpr(*key),
    )
