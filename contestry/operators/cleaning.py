"""Canonicalisation: transforms from validated rows to the canonical contest table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.text import pair_key, split_names
from contestry.operators.ordering import dense_sequence

# Playoff labels in order of play, by the number of playoff fixtures of a season.
PLAYOFF_LABELS = {
    3: ("semi_final", "semi_final", "final"),
    4: ("qualifier_1", "eliminator", "qualifier_2", "final"),
}
# The one season with another four-game format.
SPECIAL_SEASON = (2010, ("semi_final", "semi_final", "third_place", "final"))


def fail_if_null(value: Column, present: Column, message: str) -> Column:
    """``value``, or a query error naming the raw text where it did not map. Runs inside the plan."""
    return F.when(present.isNull(), value).otherwise(
        F.coalesce(value, F.raise_error(F.format_string(message + ": %s", present.cast("string"))))
    )


# -- seasons and keys -------------------------------------------------------------------------


def season_years(m: DataFrame, label: str = "season_raw", keys: tuple[str, ...] = ()) -> DataFrame:
    """Season label → calendar year of that label's first contest."""
    return m.groupBy(*keys, label).agg(F.year(F.min("date")).cast("long").alias("season_year"))


def with_season_year(m: DataFrame, label: str = "season_raw") -> DataFrame:
    return m.join(F.broadcast(season_years(m, label)), label)  # a row a label


def with_match_id(m: DataFrame, natural_key: list[str]) -> DataFrame:
    """Dense 1..n in date order, ties broken by the natural key."""
    return dense_sequence(m, "day", natural_key, "match_id")


# -- dimension mapping ------------------------------------------------------------------------


def map_team(m: DataFrame, aliases: DataFrame, raw: str, out: str, year: str = "season_year") -> DataFrame:
    """Alias → id inside the alias's validity window; an unmapped text fails the query."""
    a = aliases.select(
        F.col("alias").alias("_alias"), F.col("team_id").alias(out),
        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
    )
    j = m.join(a, (F.col(raw) == F.col("_alias")) & F.col(year).between(F.col("_from"), F.col("_to")), "left")
    return j.withColumn(out, fail_if_null(F.col(out), F.col(raw), "unmapped or expired team alias")).drop(
        "_alias", "_from", "_to"
    )


def unmapped_teams(m: DataFrame, aliases: DataFrame, raw: str, year: str = "season_year") -> DataFrame:
    """The (text, year) pairs that ``map_team`` would refuse."""
    want = m.where(F.col(raw).isNotNull()).select(F.col(raw).alias("raw"), F.col(year).alias("year")).distinct()
    return want.join(
        aliases, (F.col("raw") == F.col("alias")) & F.col("year").between(F.col("valid_from"), F.col("valid_to")),
        "left_anti",
    )


def map_venue(m: DataFrame, venue_alias: DataFrame, venues: DataFrame, raw: str = "venue_raw") -> DataFrame:
    """Venue text → id, then the venue's attributes; an unmapped text fails the query."""
    va = venue_alias.select(F.col("alias").alias("_valias"), F.col("venue_id"))
    j = m.join(va, F.col(raw) == F.col("_valias"), "left").drop("_valias")
    j = j.withColumn("venue_id", fail_if_null(F.col("venue_id"), F.col(raw), "unmapped venue"))
    attrs = venues.select("venue_id", F.col("name").alias("venue"), "city", "country")
    return j.join(attrs, "venue_id", "left")


def home_flags(m: DataFrame, spells: DataFrame, neutral: DataFrame) -> DataFrame:
    """(match_id, team, is_home): venue in a spell of the side that covers the season, and the
    season is not neutral. The sides are exploded so both come from one equi join."""
    sides = m.select("match_id", "season_year", "venue_id", F.explode(F.array("team1", "team2")).alias("team"))
    s = spells.select(
        "team", "venue_id", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.lit(1).alias("hit")
    )
    j = sides.join(s, ["team", "venue_id"], "left")
    inside = F.col("season_year").between(F.col("_from"), F.col("_to"))
    flags = j.groupBy("match_id", "team", "season_year").agg(
        F.max(F.when(F.col("hit").isNotNull() & inside, 1).otherwise(0)).alias("hit")
    )
    n = neutral.select(F.col("season_year"), F.lit(True).alias("neutral"))
    return flags.join(n, "season_year", "left").select(
        "match_id", "team", ((F.col("hit") == 1) & F.col("neutral").isNull()).alias("is_home")
    )


def with_home(m: DataFrame, spells: DataFrame, neutral: DataFrame) -> DataFrame:
    """Adds ``team1_home`` and ``team2_home``, the flags of ``home_flags``: the spells go to the contests, which stay where they lie."""
    windows = spells.groupBy("team", "venue_id").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_spells"))
    n = neutral.select("season_year", F.lit(True).alias("_neutral")).distinct()
    m = m.join(F.broadcast(n), "season_year", "left")  # a row a season
    inside = "coalesce(exists(_spells, s -> season_year BETWEEN s.valid_from AND s.valid_to), false) AND _neutral IS NULL"
    for i in (1, 2):
        m = m.join(windows.withColumnRenamed("team", f"team{i}"), [f"team{i}", "venue_id"], "left")
        m = m.withColumn(f"team{i}_home", F.expr(inside)).drop("_spells")
    return m.drop("_neutral")


def primary_home(spells: DataFrame, season_year: Column | int) -> DataFrame:
    """First listed venue of the first spell that covers the season."""
    year = season_year if isinstance(season_year, Column) else F.lit(season_year)
    return spells.where(year.between(F.col("valid_from"), F.col("valid_to"))).groupBy("team").agg(
        F.min_by("venue_id", F.struct("spell_no", "ordinal")).alias("venue_id")
    )


# -- result derivation ------------------------------------------------------------------------


def with_batting_order(m: DataFrame) -> DataFrame:
    """Batting order from the toss, never from the order of the side columns."""
    first = "CASE WHEN toss_decision = 'bat' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END"
    return m.withColumn("bat_first", F.expr(first)).withColumns(
        {
            "chasing_team": F.expr("CASE WHEN bat_first = team1 THEN team2 ELSE team1 END"),
            "team1_bats_first": F.expr("bat_first = team1"),
        }
    )


def with_result(m: DataFrame) -> DataFrame:
    """Decided flag, margin, and outcomes that stay NULL unless decided."""
    kind = "CASE WHEN NOT is_decided THEN NULL WHEN win_by_wickets > 0 THEN 'wickets' WHEN win_by_runs > 0 THEN 'runs' END"
    return m.withColumn("is_decided", F.expr("result_type = 'complete'")).withColumn("margin_type", F.expr(kind)).withColumns(
        {
            "margin_value": F.expr("CASE margin_type WHEN 'runs' THEN win_by_runs WHEN 'wickets' THEN win_by_wickets END"),
            "bat_first_won": F.expr("CASE WHEN is_decided THEN winner = bat_first END"),
            "toss_winner_won": F.expr("CASE WHEN is_decided THEN winner = toss_winner END"),
        }
    )


def with_innings(m: DataFrame) -> DataFrame:
    """Side order → first and second innings."""
    pick = "CAST(CASE WHEN team1_bats_first THEN {} ELSE {} END AS double)"
    cols = {}
    for what in ("runs", "wickets"):
        a, b = f"team1_{what}", f"team2_{what}"
        cols[f"first_innings_{what}"] = F.expr(pick.format(a, b))
        cols[f"second_innings_{what}"] = F.expr(pick.format(b, a))
    return m.withColumns(cols)


def _keyed(facts: DataFrame, *values: str) -> DataFrame:
    """Facts with one row per (date text, unordered pair)."""
    lo, hi = pair_key(F.col("team_a"), F.col("team_b"))
    return (
        facts.withColumn("_lo", lo).withColumn("_hi", hi)
        .groupBy(F.col("date_raw").alias("_date"), "_lo", "_hi")
        .agg(F.lit(True).alias("_hit"), *[F.min(v).alias(v) for v in values])
    )


def _join_facts(m: DataFrame, keyed: DataFrame) -> DataFrame:
    lo, hi = pair_key(F.col("team1"), F.col("team2"))
    cond = (F.col("date_raw") == F.col("_date")) & (lo == F.col("_lo")) & (hi == F.col("_hi"))
    return m.join(keyed, cond, "left").drop("_date", "_lo", "_hi")


def with_tie_correction(m: DataFrame, super_overs: DataFrame) -> DataFrame:
    """Undo the super-over runs of ties; a tie without a verified fact fails the query."""
    j = _join_facts(m, _keyed(super_overs, "super_over_winner", "regulation_score_tied"))
    tie = F.col("result_type") == "tie"
    score = F.when(
        tie,
        F.coalesce(
            F.col("regulation_score_tied").cast("double"),
            F.raise_error(F.format_string("tie on %s has no verified result", F.col("date_raw"))),
        ),
    )
    for c in ("first_innings_runs", "second_innings_runs"):
        j = j.withColumn(c, F.when(tie, score).otherwise(F.col(c)))
    for c in ("first_innings_wickets", "second_innings_wickets"):
        j = j.withColumn(c, F.when(~tie, F.col(c)))
    return j.withColumn("super_over_winner", F.when(tie, F.col("super_over_winner"))).drop(
        "_hit", "regulation_score_tied"
    )


def with_flag(m: DataFrame, facts: DataFrame, out: str) -> DataFrame:
    """True where the contest is in a fact list."""
    return _join_facts(m, _keyed(facts)).withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def scores_usable() -> Column:
    return F.expr("NOT (result_type = 'no result' OR voided)")


def dls_heuristic() -> Column:
    """Totals or margin kind that only a revised target can explain."""
    return F.expr(
        """coalesce(is_decided AND (
             CASE WHEN winner = team1 THEN team1_runs <= team2_runs ELSE team2_runs <= team1_runs END
             OR (bat_first_won AND win_by_wickets > 0) OR (NOT bat_first_won AND win_by_runs > 0)), false)"""
    )


# -- stages -----------------------------------------------------------------------------------


def with_stage(m: DataFrame, season_keys: list[str], special=SPECIAL_SEASON) -> DataFrame:
    """Label playoffs (no match number) by their place in the season; other counts than the known
    ones fail the query. The count is checked from a partial aggregate before any row is ranked, so
    the ranking only ever sees seasons of three or four playoffs. Their few rows go to the contests."""
    playoffs = m.where(F.col("match_number").isNull())
    counts = playoffs.groupBy(*season_keys).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("_n").isin(*PLAYOFF_LABELS)
    counts = counts.withColumn(
        "_n", F.when(ok, F.col("_n")).otherwise(F.raise_error(F.format_string("unexpected playoff count %d", "_n")))
    )
    pos = Window.partitionBy(*season_keys).orderBy("date", "match_id")
    labels = F.create_map(*[x for n, names in PLAYOFF_LABELS.items() for x in (F.lit(n), F.array(*map(F.lit, names)))])
    names = labels[F.col("_n").cast("int")]
    if special:
        names = F.when(F.col("season_year") == special[0], F.array(*map(F.lit, special[1]))).otherwise(names)
    labelled = (
        playoffs.select(*season_keys, "date", "match_id")
        .join(counts, season_keys)
        .withColumn("_pos", F.row_number().over(pos))
        .select("match_id", F.element_at(names, F.col("_pos")).alias("stage"))
    )
    return with_stage_flags(m.join(F.broadcast(labelled), "match_id", "left"))


def with_stage_flags(m: DataFrame) -> DataFrame:
    """Contests without a label belong to the league stage."""
    return (
        m.withColumn("stage", F.coalesce("stage", F.lit("league")))
        .withColumn("is_playoff", F.col("stage") != "league")
        .withColumn("is_final", F.col("stage") == "final")
    )


def with_champion(m: DataFrame, season_keys: list[str]) -> DataFrame:
    """Winner of the season's final on every row of the season."""
    champs = m.where("is_final").groupBy(*season_keys).agg(F.max("winner").alias("season_champion"))
    return m.join(F.broadcast(champs), season_keys, "left")  # a row a season


def with_era(m: DataFrame, from_year: int) -> DataFrame:
    return m.withColumn("impact_era", F.col("season_year") >= from_year)


def with_neutral(m: DataFrame, neutral: DataFrame) -> DataFrame:
    """Adds ``neutral_season``: nobody is at home in that season."""
    n = neutral.select("season_year", F.lit(True).alias("neutral_season")).distinct()
    return m.join(F.broadcast(n), "season_year", "left").withColumn("neutral_season", F.coalesce("neutral_season", F.lit(False)))


def with_renamed_sides(m: DataFrame, teams: DataFrame) -> DataFrame:
    """Adds ``renamed_sides``: how many of the two raw side texts differ from the side's present name."""
    for i in (1, 2):
        m = m.join(teams.select(F.col("team_id").alias(f"team{i}"), F.col("name").alias(f"_name{i}")), f"team{i}", "left")
    renamed = " + ".join(f"CAST(NOT team{i}_raw <=> _name{i} AS int)" for i in (1, 2))
    return m.withColumn("renamed_sides", F.expr(renamed)).drop("_name1", "_name2")


# -- squads -----------------------------------------------------------------------------------


def squads_long(m: DataFrame, separator: str = ", ") -> DataFrame:
    """Explode both squad lists with a 1-based slot."""
    sides = F.array(
        *[
            F.struct(F.col(f"team{i}").alias("team"), split_names(F.col(f"team{i}_players"), separator).alias("names"))
            for i in (1, 2)
        ]
    )
    return (
        m.select("match_id", F.explode(sides).alias("s"))
        .select("match_id", F.col("s.team").alias("team"), F.posexplode("s.names").alias("slot", "player"))
        .select("match_id", "team", "player", (F.col("slot") + 1).cast("long").alias("slot_no"))
    )


def duplicate_players(players: DataFrame) -> DataFrame:
    return players.groupBy("match_id", "team", "player").count().where("count > 1").drop("count")


# -- fix counters -----------------------------------------------------------------------------


def fix_counts(m: DataFrame, fixes: dict[str, Column]) -> DataFrame:
    """Rows (or, for numbers, texts) touched by each named correction: one aggregate, then unpivoted."""
    agg = m.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name) for name, c in fixes.items()])
    return agg.unpivot([], list(fixes), "fix", "rows")
