"""Raw text rows to canonical tables.

Three written tables cut the plan: the checked rows (both outputs and the histogram read them), the
rows in order of their ids, and the canonical rows before seasons are ranked. Each is read back with its
own pruned scan. The rows travel twice: to their place in the order, and to the facts of their date and pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.operators import cleaning as C
from contestry.operators import trends as T
from contestry.operators.records import count_if, count_rows
from contestry.operators.store import check_reference, violations
from contestry.operators.validate import Contract, rejection_histogram, split, with_reasons
from contestry.session import Stage


@dataclass
class Knowledge:
    """Dimension tables: team_alias(alias, team_id, valid_from, valid_to), teams(team_id, name, …),
    venue_alias(alias, venue_id), venues(venue_id, name, city, country),
    spells(team, venue_id, spell_no, ordinal, valid_from, valid_to), neutral(season_year)."""

    teams: DataFrame
    team_alias: DataFrame
    venues: DataFrame
    venue_alias: DataFrame
    spells: DataFrame
    neutral: DataFrame

    def reference_errors(self) -> DataFrame:
        """Ids that one dimension names and another lacks."""
        return violations(
            [
                check_reference(self.team_alias, "team_alias", "team_id", self.teams, "team_id"),
                check_reference(self.venue_alias, "venue_alias", "venue_id", self.venues, "venue_id"),
                check_reference(self.spells, "spells", "team", self.teams, "team_id"),
                check_reference(self.spells, "spells", "venue_id", self.venues, "venue_id"),
            ]
        )

    def check(self) -> None:
        bad = self.reference_errors().limit(5).collect()  # at most five rows
        if bad:
            raise ValueError(f"dimension tables do not fit together: {[tuple(r) for r in bad]}")


@dataclass
class Facts:
    """External lists keyed by (date_raw, unordered pair of raw side texts)."""

    super_overs: DataFrame
    dls: DataFrame
    voided: DataFrame


def _map_fact_teams(facts: DataFrame, k: Knowledge, *cols: str) -> DataFrame:
    """Fact lists name sides by any alias, in or out of its window; an unknown side fails the query."""
    alias = k.team_alias.groupBy("alias").agg(F.min("team_id").alias("_id"))
    for c in cols:
        facts = facts.join(alias.withColumnRenamed("alias", c), c, "left")
        facts = facts.withColumn(c, C.fail_if_null(F.col("_id"), F.col(c), "unmapped side in a fact list")).drop("_id")
    return facts


def clean(valid: DataFrame, k: Knowledge, facts: Facts, era_from: int, season_keys=("season_year",), special=C.SPECIAL_SEASON) -> DataFrame:
    """Typed valid rows to the canonical table."""
    stage = Stage(valid.sparkSession, "clean")
    m = valid.withColumnsRenamed({"date": "date_raw", "season": "season_raw", "venue": "venue_raw", "city": "city_raw", **{c: f"{c}_raw" for c in ("team1", "team2", "toss_winner", "winner")}})
    m = m.withColumn("date", F.to_date("date_raw", "dd-MM-yyyy")).withColumn("day", F.unix_date("date"))
    m = C.with_match_id(m, ["venue_raw", "team1_raw", "team2_raw"])
    m = C.with_season_year(m)
    for c in ("team1", "team2", "toss_winner", "winner"):
        m = C.map_team(m, k.team_alias, f"{c}_raw", c)
    m = C.with_renamed_sides(m, k.teams)
    m = C.map_venue(m, k.venue_alias, k.venues)
    m = C.with_innings(C.with_result(C.with_batting_order(m)))
    m = C.with_tie_correction(m, _map_fact_teams(facts.super_overs, k, "team_a", "team_b", "super_over_winner"))
    m = C.with_flag(m, _map_fact_teams(facts.voided, k, "team_a", "team_b"), "voided")
    m = C.with_flag(m, _map_fact_teams(facts.dls, k, "team_a", "team_b"), "dls_external")
    m = m.withColumns({"scores_usable": C.scores_usable(), "dls_heuristic": C.dls_heuristic()})
    m = stage.write(m.withColumn("dls_flag", F.expr("dls_heuristic OR dls_external")), "results")
    m = C.with_champion(C.with_stage(m, list(season_keys), special), list(season_keys))
    m = C.with_home(C.with_neutral(C.with_era(m, era_from), k.neutral), k.spells, k.neutral)
    return m.withColumns({f"n_players_t{i}": F.size(C.split_names(F.col(f"team{i}_players"))) for i in (1, 2)})


@dataclass
class Canonical:
    matches: DataFrame
    players: DataFrame
    rejected: DataFrame
    reasons: DataFrame
    fixes: DataFrame


def fixes(m: DataFrame) -> DataFrame:
    """Counts of every correction: rows, but for side names and squad lists, of which a row has two."""
    return C.fix_counts(
        m,
        {  # Fixed values: names of the counters.
            "season_label_mapped": F.expr("season_raw <> CAST(season_year AS string)"),
            "team_alias_canonicalised": F.col("renamed_sides"),
            "venue_alias_canonicalised": F.expr("venue_raw <> venue"),
            "city_unknown_imputed": F.expr("city_raw = 'Unknown'"),
            "city_corrected": F.expr("city_raw <> 'Unknown' AND city_raw <> city"),
            "tie_innings_corrected_super_over_removed": F.expr("result_type = 'tie'"),
            "voided_flagged": F.col("voided"),
            "no_result_scores_excluded": ~F.col("scores_usable"),
            "dls_flag_heuristic": F.col("dls_heuristic"),
            "dls_flag_external": F.col("dls_external"),
            "dls_flag_total": F.col("dls_flag"),
            "stage_derived_playoff": F.col("is_playoff"),
            "player_lists_parsed": F.lit(2),
        },
    )


def notes(m: DataFrame, k: Knowledge, facts: Facts) -> DataFrame:
    """(note, rows): contests, decided ones, and entries of the fact lists that met no contest."""
    dls = _map_fact_teams(facts.dls, k, "team_a", "team_b")
    keys = dls.select("date_raw", F.least("team_a", "team_b").alias("a"), F.greatest("team_a", "team_b").alias("b")).distinct()
    n = m.agg(
        count_rows().alias("n_matches"), count_if(F.col("is_decided")).alias("n_decided"),
        count_if(F.col("result_type") == "tie").alias("_ties"), count_if(F.col("dls_external")).alias("_dls"),
    )
    listed = facts.super_overs.agg(count_rows()).scalar(), keys.agg(count_rows()).scalar()
    n = n.withColumns({"super_over_records_unmatched": listed[0] - F.col("_ties"), "dls_external_unmatched": listed[1] - F.col("_dls")})
    return n.drop("_ties", "_dls").unpivot([], ["n_matches", "n_decided", "super_over_records_unmatched", "dls_external_unmatched"], "note", "rows")


def build(raw: DataFrame, k: Knowledge, facts: Facts, contract: Contract = Contract(), mode: str = "lenient", era_from: int = 2023, **kw) -> Canonical:
    """Validate and clean. Strict mode raises on the first rejected rows."""
    k.check()
    checked = Stage(raw.sparkSession, "checked").write(with_reasons(raw, contract), "rows")
    valid, bad = split(checked)
    if mode == "strict":
        first = bad.select("reason").limit(5).collect()  # at most five rows
        if first:
            raise ValueError(f"rows failed validation: {[r.reason for r in first]}")
    m = clean(valid, k, facts, era_from, **kw)
    players = C.squads_long(m, contract.separator)
    dup = players.groupBy("match_id", "team", "player").agg(F.count(F.lit(1)).alias("_n"), F.min("slot_no").alias("slot_no"))
    players = dup.select(
        "match_id", "team",
        F.when(F.col("_n") == 1, F.col("player")).otherwise(F.raise_error(F.format_string("player listed twice on a side: %s", "player"))).alias("player"),
        "slot_no",
    )
    return Canonical(m, players, bad, rejection_histogram(checked), fixes(m))


def quality_report(c: Canonical) -> dict[str, DataFrame]:
    """Tidy sections of the quality report."""
    m = c.matches
    return {
        "nulls": T.null_counts(m), "reasons": c.reasons, "fixes": c.fixes, "seasons": T.season_rollup(m),
        "identity": T.distinct_counts(m, {"raw_sides": ["team1_raw", "team2_raw"], "sides": ["team1", "team2"], "raw_venues": ["venue_raw"], "venues": ["venue_id"]}),
        "toss_decisions": T.value_counts(m, "toss_decision"), "results": T.value_counts(m, "result_type"),
        "dictionary": T.data_dictionary(m.drop("team1_players", "team2_players")),
        "exceptions": m.where("dls_flag OR voided OR result_type = 'tie'"),
    }
