"""Dimension and store operators: upserts, stable ids, fact refresh, integrity, views, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.operators.ordering import dense_sequence
from contestry.operators.records import count_if, count_rows
from contestry.session import Stage


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those with the same key, others are added; nothing else changes."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def ensure_names(existing: DataFrame, names: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """Known names keep their ids; new names get the next ids in name order."""
    known = existing.select(name, F.col(id_col).cast("long").alias(id_col))
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = dense_sequence(fresh.withColumn("_k", F.lit(0)), "_k", [name], "_n")
    return known.unionByName(numbered.select(name, (top + F.col("_n")).alias(id_col)))


def resolve(facts: DataFrame, lookups: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Replace name columns by ids: ``{column: (dimension, name column, id column)}``. A name the
    dimension lacks fails the query; NULL stays NULL."""
    out = facts
    for col, (dim, name, id_col) in lookups.items():
        d = dim.select(F.col(name).alias("_n"), F.col(id_col).alias(f"{col}_id"))
        out = out.join(d, F.col(col) == F.col("_n"), "left").drop("_n")
        missing = F.raise_error(F.format_string(f"{col} has no id: %s", F.col(col).cast("string")))
        out = out.withColumn(f"{col}_id", F.when(F.col(col).isNotNull(), F.coalesce(f"{col}_id", missing)))
    return out.drop(*lookups)


# Columns of a contest that name an official.
OFFICIALS = ("match_referee", "umpire1", "umpire2", "tv_umpire", "reserve_umpire")


def person_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name): all texts of the columns, once each."""
    return df.select(F.explode(F.array(*columns)).alias("name")).where("name IS NOT NULL").distinct()


def refresh_people(m: DataFrame, players: DataFrame, known_players: DataFrame | None = None, known_officials: DataFrame | None = None) -> dict[str, DataFrame]:
    """Person dimensions brought up to date, and contests and squads with ids in place of names.

    Awards and squads share one dimension, the five kinds of officials another. Known names keep their ids.
    """
    stage = Stage(m.sparkSession, "people")
    none = m.sparkSession.createDataFrame([], "name string, id long")
    names = person_names(players, ["player"]).unionByName(person_names(m, ["player_of_match"]))
    person = stage.write(ensure_names(none if known_players is None else known_players, names), "players")
    official = stage.write(ensure_names(none if known_officials is None else known_officials, person_names(m, OFFICIALS)), "officials")
    return {
        "players": person, "officials": official, "squads": resolve(players, {"player": (person, "name", "id")}),
        "contests": resolve(m, {"player_of_match": (person, "name", "id"), **{c: (official, "name", "id") for c in OFFICIALS}}),
    }


def season_dimension(m: DataFrame, keys: Sequence[str] = ("season_year",)) -> DataFrame:
    """Label, contests and champion per season."""
    return m.groupBy(*keys).agg(
        F.min_by("season_raw", F.struct("date", "match_id")).alias("label"), count_rows().alias("matches"),
        F.max("season_champion").alias("champion"),
    )


def violations(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _tag(df: DataFrame, kind: str, table: str, key: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(table).alias("table"), key.cast("string").alias("key"))


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    dup = df.groupBy(*keys).agg(count_rows().alias("_n")).where("_n > 1")
    return _tag(dup, "unique", table, F.concat_ws("|", *keys))


def check_reference(df: DataFrame, table: str, column: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct values of ``column`` without a row in the dimension."""
    vals = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    return _tag(vals.join(dim.select(F.col(dim_key).alias("_v")), "_v", "left_anti"), "reference", f"{table}.{column}", F.col("_v"))


def check_rows(df: DataFrame, table: str, name: str, predicate: str, key: str) -> DataFrame:
    return _tag(df.where(f"NOT coalesce({predicate}, true)"), "check", f"{table}.{name}", F.col(key))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(count_rows().alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    return violations(parts)


# -- views ------------------------------------------------------------------------------------


def team_season_summary(m: DataFrame) -> DataFrame:
    """Per season and side, voided contests included. Both memberships come from one explode, where
    the disjunction ``side IN (team1, team2)`` would compare every contest with every side."""
    side = m.select("season_year", "winner", "result_type", F.explode(F.array("team1", "team2")).alias("team"))
    done = F.col("result_type") == "complete"
    return side.groupBy("season_year", "team").agg(
        count_rows().alias("matches"), count_if(F.col("winner") == F.col("team")).alias("wins"),
        count_if(done & (F.col("winner") != F.col("team"))).alias("losses"), count_if(~done).alias("no_decision"),
    )


def head_to_head_all(m: DataFrame) -> DataFrame:
    """Per ordered pair over all meetings, undecided ones included."""
    pair = m.select("winner", F.expr("explode(array(struct(team1 AS team, team2 AS opponent), struct(team2 AS team, team1 AS opponent))) AS p"))
    return pair.select("winner", "p.*").groupBy("team", "opponent").agg(
        count_rows().alias("meetings"), count_if(F.col("winner") == F.col("team")).alias("wins"),
        count_if(F.col("winner") == F.col("opponent")).alias("losses"),
    )


def register_views(spark: SparkSession, m: DataFrame, players: DataFrame) -> None:
    m.createOrReplaceTempView("contest")
    players.createOrReplaceTempView("contest_player")
    team_season_summary(m).createOrReplaceTempView("team_season_summary")
    head_to_head_all(m).createOrReplaceTempView("head_to_head_all")


# -- reads with bound parameters --------------------------------------------------------------


def matches_of_season(spark: SparkSession, season: int) -> DataFrame:
    return spark.sql("SELECT * FROM contest WHERE season_year = :s ORDER BY date, match_id", args={"s": season})


def matches_of_team(spark: SparkSession, team) -> DataFrame:
    return spark.sql("SELECT * FROM contest WHERE team1 = :t OR team2 = :t ORDER BY date, match_id", args={"t": team})


def squads_of_match(spark: SparkSession, match_id: int) -> DataFrame:
    return spark.sql("SELECT * FROM contest_player WHERE match_id = :m ORDER BY team, slot_no", args={"m": match_id})


def summary_of_team(spark: SparkSession, team) -> DataFrame:
    return spark.sql("SELECT * FROM team_season_summary WHERE team = :t ORDER BY season_year", args={"t": team})


# -- logs and registries ----------------------------------------------------------------------


def log_predictions(scored: DataFrame, path: str) -> None:
    """Append scored fixtures; probabilities outside [0, 1] fail the write."""
    p = F.when(F.col("p_a").between(0, 1), F.col("p_a")).otherwise(F.raise_error(F.lit("p_a outside [0, 1]")))
    toss = F.when(
        F.col("tier") == "post_toss",
        F.to_json(F.struct(F.col("toss_winner").alias("winner"), F.col("toss_decision").alias("decision"))),
    )
    scored.withColumn("p_a", p).select(
        F.current_timestamp().alias("created_at"), "run_id", "tier", "team_a", "team_b", "venue_id", "stage",
        toss.alias("toss_json"), "p_a",
    ).write.mode("append").parquet(path)


def latest_predictions(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "team_a", "team_b", "venue_id", "stage", "toss_json", "p_a").limit(n)


def record_run(existing: DataFrame | None, run: DataFrame) -> DataFrame:
    """Model runs, one row per ``run_id``."""
    return run if existing is None else upsert(existing, run, ["run_id"])
