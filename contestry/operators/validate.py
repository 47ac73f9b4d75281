"""Validation of all-text rows against a contract: reasons per row, quarantine, typed rows.

All checks are one projection: every rule yields its reason or NULL, and the array of reasons decides
where the row goes. No rule needs a join, a second pass or a Python function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.text import null_tokens_to_null
from contestry.session import Stage

# The raw file's columns and the texts it must carry.
RAW_COLUMNS = (
    "event_name", "season", "match_number", "date", "city", "venue", "team1", "team2", "toss_winner", "toss_decision",
    "team1_runs", "team1_wickets", "team2_runs", "team2_wickets", "winner", "result_type", "win_by_runs",
    "win_by_wickets", "player_of_match", "match_referee", "umpire1", "umpire2", "tv_umpire", "reserve_umpire",
    "match_type", "overs_limit", "balls_per_over", "gender", "team_type", "team1_players", "team2_players",
)
CONSTANTS = {
    "event_name": "Indian Premier League", "match_type": "T20", "overs_limit": "20", "balls_per_over": "6",
    "gender": "male", "team_type": "club",
}
DOMAINS = {"toss_decision": ("bat", "field"), "result_type": ("complete", "tie", "no result")}
RANGES = {
    "team1_runs": (0, 350), "team1_wickets": (0, 20), "team2_runs": (0, 350), "team2_wickets": (0, 20),
    "win_by_runs": (0, 300), "win_by_wickets": (0, 10),
}
PATTERNS = {"season": r"^\d{4}(/\d{2})?$", "date": r"^\d{2}-\d{2}-\d{4}$"}
NULLABLE = (
    "match_number", "winner", "player_of_match", "match_referee", "umpire1", "umpire2", "tv_umpire", "reserve_umpire",
)


@dataclass(frozen=True)
class Contract:
    constants: dict = field(default_factory=lambda: dict(CONSTANTS))
    squad: tuple[int, int] = (11, 13)
    separator: str = ", "


def check_columns(columns: Sequence[str]) -> None:
    """Missing and unexpected columns both fail, in every mode."""
    missing = [c for c in RAW_COLUMNS if c not in columns]
    extra = [c for c in columns if c not in RAW_COLUMNS]
    if missing or extra:
        raise ValueError(f"column mismatch; missing: {missing}; unexpected: {extra}")


def _typed(c: str) -> Column:
    if c == "match_number":
        return F.expr("try_cast(match_number AS double)")
    if c in RANGES or c in ("overs_limit", "balls_per_over"):
        return F.expr(f"try_cast({c} AS int)")
    return F.col(c)


def schema_reasons(contract: Contract) -> list[Column]:
    """Column checks; a NULL only fails where the column may not be NULL."""
    out = []

    def rule(c: str, name: str, fails: Column) -> None:
        out.append(F.when(F.coalesce(fails, F.lit(False)), F.lit(f"schema:{c}:{name}")))

    for c in RAW_COLUMNS:
        raw, typed = F.col(c), _typed(c)
        if c not in NULLABLE:
            rule(c, "not_nullable", raw.isNull())
        if c == "match_number" or c in RANGES or c in ("overs_limit", "balls_per_over"):
            kind = "float64" if c == "match_number" else "int64"
            rule(c, f"coerce_dtype('{kind}')", raw.isNotNull() & typed.isNull())
        if c == "match_number":
            rule(c, "greater_than_or_equal_to(1)", typed < 1)
        if c in PATTERNS:
            rule(c, f"str_matches('{PATTERNS[c]}')", ~raw.rlike(PATTERNS[c]))
        if c in DOMAINS:
            rule(c, f"isin({list(DOMAINS[c])})", ~raw.isin(*DOMAINS[c]))
        if c in RANGES:
            lo, hi = RANGES[c]
            rule(c, f"in_range({lo}, {hi})", ~typed.between(lo, hi))
        if c in contract.constants:
            want = contract.constants[c]
            same = typed == int(want) if c in ("overs_limit", "balls_per_over") else raw == want
            shown = f"[{want}]" if c in ("overs_limit", "balls_per_over") else f"['{want}']"
            rule(c, f"isin({shown})", ~same)
    return out


def row_rules(contract: Contract) -> dict[str, str]:
    """Named violations over typed columns, as SQL predicates."""
    lo, hi = contract.squad
    sep = contract.separator.replace(" ", "[ ]")
    size = "size(split({}, '" + sep + "')) BETWEEN " + f"{lo} AND {hi}"
    return {
        "distinct_teams": "team1 = team2",
        "toss_winner_in_match": "toss_winner NOT IN (team1, team2)",
        "winner_in_match": "winner IS NOT NULL AND winner NOT IN (team1, team2)",
        "winner_iff_complete": "(winner IS NOT NULL) <> (result_type = 'complete')",
        "single_margin": "result_type = 'complete' AND (win_by_runs > 0) = (win_by_wickets > 0)",
        "no_margin_without_result": "result_type <> 'complete' AND (win_by_runs > 0 OR win_by_wickets > 0)",
        "wickets_le_10_unless_tie": "result_type <> 'tie' AND (team1_wickets > 10 OR team2_wickets > 10)",
        "valid_date": "try_to_date(date, 'dd-MM-yyyy') IS NULL",
        "squad_size": f"NOT ({size.format('team1_players')}) OR NOT ({size.format('team2_players')})",
    }


def with_reasons(raw: DataFrame, contract: Contract = Contract(), carry: Sequence[str] = ()) -> DataFrame:
    """Raw text columns, the typed row as struct ``typed``, and the array ``reasons``.

    A row that fails a column check carries only those reasons; the row rules see typed rows.
    """
    check_columns([c for c in raw.columns if c not in carry])
    text = raw.select(*carry, *[null_tokens_to_null(F.col(c)).alias(c) for c in RAW_COLUMNS])
    schema = F.array_compact(F.array(*schema_reasons(contract)))
    typed = F.struct(*[_typed(c).alias(c) for c in RAW_COLUMNS])
    x = text.withColumn("typed", typed).withColumn("_schema", schema)
    names = {c: f"typed.{c}" for c in RAW_COLUMNS}
    rules = []
    t = x.select("*", *[F.col(p).alias(f"_t_{c}") for c, p in names.items()])
    import re

    for name, predicate in row_rules(contract).items():
        # Rewrite bare column names to the typed copies.
        pred = re.sub(r"\b(" + "|".join(RAW_COLUMNS) + r")\b(?!')", r"_t_\1", predicate)
        rules.append(F.when(F.coalesce(F.expr(pred), F.lit(True)), F.lit(f"rule:{name}")))
    reasons = F.when(F.size("_schema") > 0, F.col("_schema")).otherwise(F.array_compact(F.array(*rules)))
    return t.withColumn("reasons", reasons).select(*carry, *RAW_COLUMNS, "typed", "reasons")


def split(checked: DataFrame, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, rejected raw rows with ``reason``)."""
    valid = checked.where(F.size("reasons") == 0).select(*carry, "typed.*")
    bad = checked.where(F.size("reasons") > 0).select(
        *carry, *RAW_COLUMNS, F.array_join("reasons", "; ").alias("reason")
    )
    return valid, bad


def validate(raw: DataFrame, contract: Contract = Contract(), mode: str = "lenient", carry: Sequence[str] = (), show: int = 5):
    """Lenient mode splits; strict mode raises with the first rejected rows.

    The checked rows are written once: both outputs filter a stored column, where a filter pushed
    into the rule expressions would evaluate all of them several times.
    """
    checked = Stage(raw.sparkSession, "checked").write(with_reasons(raw, contract, carry), "rows")
    valid, bad = split(checked, carry)
    if mode == "strict":
        first = bad.select(*carry, "reason").limit(show).collect()  # at most ``show`` rows
        if first:
            raise ValueError(f"rows failed validation, among them: {[tuple(r) for r in first]}")
    return valid, bad


def rejection_histogram(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
