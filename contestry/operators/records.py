"""Records of sides, head-to-head tables, toss and venue analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.stats import minimum_detectable_effect, ratio, shrink, two_proportion, wilson
from contestry.functions.tails import binom_two_sided_p, chi2_p, normal_two_sided_p

def count_rows() -> Column:
    return F.count(F.lit(1))



def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def decided(m: DataFrame) -> DataFrame:
    return m.where("is_decided")


def filter_matches(m: DataFrame, season_from=None, season_to=None, team=None, venue_id=None, stage=None) -> DataFrame:
    """Optional filters; each reaches the scan as a pushed predicate where the column is stored."""
    if season_from is not None:
        m = m.where(F.col("season_year") >= season_from)
    if season_to is not None:
        m = m.where(F.col("season_year") <= season_to)
    if team is not None:
        m = m.where((F.col("team1") == team) | (F.col("team2") == team))
    if venue_id is not None:
        m = m.where(F.col("venue_id") == venue_id)
    if stage == "playoff":
        m = m.where("is_playoff")
    elif stage is not None:
        m = m.where(F.col("stage") == stage)
    return m


#: Sides of a contest that the explorer shows by name.
NAMED_SIDES = ("team1", "team2", "toss_winner", "bat_first", "winner")
# The explorer's columns in order.
EXPLORER_COLUMNS = (
    "date", "season_year", "stage", "team1", "team2", "venue", "city", "toss_winner", "toss_decision", "bat_first", "first_innings_runs",
    "second_innings_runs", "winner", "result_type", "margin_type", "margin_value", "dls_flag", "player_of_match",
)


def explorer(m: DataFrame, names: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The explorer's columns, with names(team_id, name) for side ids and a readable date; ``keep`` comes first.

    Both sides get their names by a join; toss, batting order and winner are one of the two.
    """
    for i in (1, 2):
        m = m.join(names.select(F.col("team_id").alias(f"team{i}"), F.col("name").alias(f"_name{i}")), f"team{i}", "left")
    shown = {c: F.when(F.col(c) == F.col("team1"), F.col("_name1")).when(F.col(c) == F.col("team2"), F.col("_name2")) for c in NAMED_SIDES}
    shown["date"] = F.date_format("date", "dd MMM yyyy")
    return m.select(*keep, *[shown.get(c, F.col(c)).alias(c) for c in EXPLORER_COLUMNS])


def team_long(m: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two rows per contest, one per side, from a single scan."""
    usable = "scores_usable AND result_type <> 'tie'"

    def side(me: str, other: str) -> str:
        return (
            f"struct({me} AS team, {other} AS opponent, {me}_home AS is_home, {other}_home AS opp_home, "
            f"bat_first = {me} AS bats_first, CASE WHEN is_decided THEN winner = {me} END AS won, "
            f"CASE WHEN {usable} THEN {me}_runs END AS runs_for, CASE WHEN {usable} THEN {other}_runs END AS runs_against)"
        )

    common = ["match_id", "date", "season_year", "venue_id", "is_decided", "voided", *keep]
    common += [c for c in ("league", "stage") if c in m.columns and c not in common]
    return m.select(*common, F.expr(f"explode(array({side('team1', 'team2')}, {side('team2', 'team1')})) AS s")).select(
        *common, "s.*"
    )


def season_win_pct(m: DataFrame) -> DataFrame:
    """Per side and season, voided contests left out; NULL where nothing was decided."""
    g = team_long(m.where("NOT voided")).groupBy("season_year", "team")
    return g.agg(
        count_rows().alias("matches"),
        count_if(F.col("is_decided")).alias("decided"),
        count_if(F.col("won")).alias("wins"),
    ).withColumn("win_pct", ratio(F.col("wins"), F.col("decided")))


def team_table(m: DataFrame, min_decided: int = 5) -> DataFrame:
    """All-time record per side. The facts are shuffled once, to the (season, side) grain; the rest
    runs on that table. Finals count voided contests too; the record does not."""
    seasons = season_win_pct(m)
    eligible = F.when(F.col("decided") >= min_decided, F.col("win_pct"))
    # Ties go to the earliest season: the sort key pairs the rate with the (negated) year.
    out = seasons.groupBy("team").agg(
        count_rows().alias("seasons"),
        F.sum("matches").alias("matches"),
        F.sum("wins").alias("wins"),
        F.sum(F.col("decided") - F.col("wins")).alias("losses"),
        F.max(F.when(eligible.isNotNull(), F.struct(eligible, (-F.col("season_year")).alias("y")))).alias("_best"),
        F.min(F.when(eligible.isNotNull(), F.struct(eligible, F.col("season_year").alias("y")))).alias("_worst"),
    )
    low, high = wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    finals = (
        m.where("is_final")
        .select(F.explode(F.array("team1", "team2")).alias("team"), "winner")
        .groupBy("team")
        .agg(count_if(F.col("winner") == F.col("team")).alias("titles"), count_rows().alias("finals"))
    )
    return out.join(finals, "team", "left").select(
        "team", "seasons", "matches", "wins", "losses",
        (F.col("matches") - F.col("wins") - F.col("losses")).alias("no_decision"),
        ratio(F.col("wins"), F.col("wins") + F.col("losses")).alias("win_pct"),
        low.alias("ci_low"), high.alias("ci_high"),
        F.coalesce("titles", F.lit(0)).alias("titles"), F.coalesce("finals", F.lit(0)).alias("finals"),
        (-F.col("_best.y")).alias("best_season"), F.col("_worst.y").alias("worst_season"),
    )


def head_to_head(m: DataFrame, min_meetings: int = 1) -> DataFrame:
    """Decided meetings per ordered pair."""
    g = team_long(m.where("is_decided")).groupBy("team", "opponent")
    out = g.agg(count_rows().alias("meetings"), count_if(F.col("won")).alias("wins"))
    return out.where(F.col("meetings") >= min_meetings).withColumn(
        "win_pct", ratio(F.col("wins"), F.col("meetings"))
    )


def head_to_head_matrix(m: DataFrame, opponents: Sequence, min_meetings: int = 5) -> DataFrame:
    """One column per listed opponent. The columns are named by the caller, so no distinct pass
    runs first and the width stays bounded."""
    h = head_to_head(m.where(F.col("team1").isin(*opponents) | F.col("team2").isin(*opponents)), min_meetings)
    return h.groupBy("team").pivot("opponent", list(opponents)).agg(F.first("win_pct"))


def head_to_head_cells(m: DataFrame, min_meetings: int = 5) -> DataFrame:
    """The whole matrix as (team, opponent, win_pct), a row for every ordered pair that met; the rate is
    NULL below ``min_meetings``. Its size follows the pairs, so no list of opponents is needed."""
    return head_to_head(m).select("team", "opponent", F.when(F.col("meetings") >= min_meetings, F.col("win_pct")).alias("win_pct"))


def rate_table(df: DataFrame, by: str | Sequence[str], flag: Column) -> DataFrame:
    """successes, n, rate and Wilson interval per key."""
    keys = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*keys).agg(count_if(flag).alias("successes"), count_rows().alias("n"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return g.select(
        *keys, "successes", "n", ratio(F.col("successes"), F.col("n")).alias("rate"),
        low.alias("ci_low"), high.alias("ci_high"),
    )


def binomial_columns(g: DataFrame, successes: str = "successes", n: str = "n", p0: float = 0.5) -> DataFrame:
    """Rate, Wilson interval, effect, exact p-value and detectable effect on aggregate rows."""
    s, nn = F.col(successes), F.col(n)
    low, high = wilson(s, nn)
    return (
        g.withColumn("rate", ratio(s, nn))
        .withColumn("ci_low", low)
        .withColumn("ci_high", high)
        .withColumn("effect", F.col("rate") - p0)
        .withColumn("mde", minimum_detectable_effect(nn, p0))
        .withColumn("p_value", binom_two_sided_p(s, nn, F.lit(p0)))
    )


def home_advantage(m: DataFrame) -> dict[str, DataFrame]:
    """Decided contests where exactly one side is at home."""
    d = m.where("is_decided AND team1_home <> team2_home")
    host = F.when(F.col("team1_home"), F.col("team1")).otherwise(F.col("team2"))
    won = F.col("winner") == host
    by_season = d.groupBy("season_year").agg(F.avg(won.cast("double")).alias("home_win_rate"), count_rows().alias("n"))
    overall = d.agg(count_if(won).alias("successes"), count_rows().alias("n"))
    return {"overall": binomial_columns(overall), "by_season": by_season}


def era_test(df: DataFrame, flag: Column) -> DataFrame:
    """Two-proportion test, new era minus old, from one conditional aggregate."""
    new = F.col("impact_era")
    g = df.agg(
        count_if(new & flag).alias("s_a"), count_if(new).alias("n_a"),
        count_if(~new & flag).alias("s_b"), count_if(~new).alias("n_b"),
    )
    t = two_proportion(F.col("s_a"), F.col("n_a"), F.col("s_b"), F.col("n_b"))
    return g.select("n_a", "n_b", *[c.alias(k) for k, c in t.items()]).withColumn("p_value", normal_two_sided_p("z"))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Independence of two columns: χ² without correction, degrees of freedom, Cramér's V, tail.

    The contingency cells come from one aggregate; margins and the cells that stay empty are
    derived from that table: Σ O²/E - N counts them without listing them.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(
        F.col(row).alias("_rk"), F.col(col).alias("_ck")
    ).agg(count_rows().alias("_o"))
    rows = cells.groupBy("_rk").agg(F.sum("_o").alias("_r"))
    cols = cells.groupBy("_ck").agg(F.sum("_o").alias("_c"))
    g = cells.join(rows, "_rk").join(cols, "_ck").agg(
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("phi"),
        F.sum("_o").alias("n"), F.count_distinct("_rk").alias("nr"), F.count_distinct("_ck").alias("nc"),
    )
    k = F.least("nr", "nc") - 1
    out = g.select(
        "n",
        (F.col("n") * (F.col("phi") - 1)).alias("chi2"),
        ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"),
        k.alias("_k"),
    )
    return out.withColumn(
        "cramers_v", F.when(F.col("_k") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("chi2")) / (F.col("n") * F.col("_k"))))
    ).withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof").cast("double"))).drop("_k")


def with_era_label(m: DataFrame) -> DataFrame:
    return m.withColumn("era", F.when(F.col("impact_era"), "new").otherwise("old"))


def toss_effect(m: DataFrame) -> dict[str, DataFrame]:
    d = with_era_label(decided(m))
    won = F.col("toss_winner_won")
    return {
        "overall": binomial_columns(d.agg(count_if(won).alias("successes"), count_rows().alias("n"))),
        "by_decision": rate_table(d, "toss_decision", won),
        "by_era": rate_table(d, "era", won),
        "era_test": era_test(d, won),
        "decision_outcome": chi_square(d, "toss_decision", "toss_winner_won"),
    }


def chasing_advantage(m: DataFrame) -> dict[str, DataFrame]:
    d, won = decided(m), ~F.col("bat_first_won")
    return {
        "overall": binomial_columns(d.agg(count_if(won).alias("successes"), count_rows().alias("n"))),
        "by_season": rate_table(d, "season_year", won),
        "era_test": era_test(d, won),
    }


def field_first_share(m: DataFrame) -> DataFrame:
    """All contests, decided or not."""
    return rate_table(m, "season_year", F.col("toss_decision") == "field")


def holm(df: DataFrame, p: str, tie_break: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment over all rows, with the number of hypotheses on the rows.

    Rows that share a p-value share their adjusted value: the first of them has the largest factor
    and the running maximum carries it on. So only distinct p-values need an order.
    """
    from contestry.operators.ordering import rank_values
    from pyspark.sql import Window

    ranked = rank_values(df, p)
    step = F.least(F.lit(1.0), (F.col("n_total") - F.col("n_before")) * F.col(p))
    steps = ranked.select(F.col(p), step.alias("_step"), F.floor(F.col("n_before") / 4096).alias("_b"))
    # Two-level running maximum: inside blocks of ranks, then over the short table of blocks.
    blocks = steps.groupBy("_b").agg(F.max("_step").alias("_m"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.max("_m").over(upto).alias("_prev"))
    inner = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    adj = steps.join(blocks, "_b").select(
        p, F.greatest(F.max("_step").over(inner), F.coalesce("_prev", F.lit(0.0))).alias(out)
    )
    return df.join(adj, p, "left")


def toss_by_venue(m: DataFrame, min_matches: int = 20) -> DataFrame:
    """Toss-winner rate per place with exact tests, Holm-adjusted over the places that qualify."""
    g = decided(m).groupBy("venue_id").agg(count_if(F.col("toss_winner_won")).alias("successes"), count_rows().alias("n"))
    t = binomial_columns(g.where(F.col("n") >= min_matches)).select(
        "venue_id", "n", "rate", "ci_low", "ci_high", "p_value"
    )
    return holm(t, "p_value", ["venue_id"])


def venue_profiles(m: DataFrame, prior_strength: float = 10.0) -> DataFrame:
    """Volume, raw and shrunk scoring and batting-first rates per place: one conditional aggregate,
    with the overall values as a scalar subquery over the per-place table."""
    scored = F.col("scores_usable") & F.col("first_innings_runs").isNotNull()
    extra = [F.min(c).alias(c) for c in ("venue", "city", "country") if c in m.columns]
    g = m.groupBy("venue_id").agg(
        *extra,
        count_rows().alias("matches"),
        count_if(F.col("is_decided")).alias("decided"),
        count_if(F.col("bat_first_won")).alias("bf_wins"),
        F.coalesce(F.sum(F.when(scored, F.col("first_innings_runs"))), F.lit(0.0)).alias("runs"),
        count_if(scored).alias("n_runs"),
        F.min("season_year").alias("first_season"),
        F.max("season_year").alias("last_season"),
        F.avg((F.col("toss_decision") == "field").cast("double")).alias("field_share"),
    )
    overall = g.agg(
        F.struct(
            (F.sum("runs") / F.sum("n_runs")).alias("mean"), (F.sum("bf_wins") / F.sum("decided")).alias("rate")
        ).alias("o")
    ).scalar()
    out = g.withColumn("_o", overall)
    bf = shrink(F.col("bf_wins"), F.col("decided"), F.col("_o.rate"), prior_strength)
    return out.select(
        "venue_id", *[c for c in ("venue", "city", "country") if c in m.columns],
        "matches", "decided", "first_season", "last_season",
        ratio(F.col("runs"), F.col("n_runs")).alias("avg_first_innings"),
        shrink(F.col("runs"), F.col("n_runs"), F.col("_o.mean"), prior_strength).alias("avg_first_innings_shrunk"),
        ratio(F.col("bf_wins"), F.col("decided")).alias("bat_first_win_rate"),
        bf.alias("bat_first_win_rate_shrunk"),
        (1 - bf).alias("chase_win_rate_shrunk"),
        "field_share",
    )


def kpis(m: DataFrame) -> DataFrame:
    """Headline counts. Distinct sides and places come from their own small tables, so the fact
    scan carries no distinct expansion."""
    sides = m.select(F.explode(F.array("team1", "team2")).alias("t")).groupBy("t").agg(F.lit(1).alias("x"))
    n_sides = sides.agg(count_rows().alias("n")).scalar()
    n_places = m.groupBy("venue_id").agg(F.lit(1).alias("x")).agg(count_rows().alias("n")).scalar()
    final = F.struct("date", "match_id")
    return m.agg(
        count_rows().alias("matches"),
        count_if(F.col("is_decided")).alias("decided"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by(F.when(F.col("is_final"), F.col("winner")), F.when(F.col("is_final"), final)).alias("champion"),
    ).select("*", n_sides.alias("sides"), n_places.alias("places"))


def active_sides(m: DataFrame) -> DataFrame:
    """Sides of the latest season."""
    latest = m.agg(F.max("season_year")).scalar()
    return m.where(F.col("season_year") == latest).select(F.explode(F.array("team1", "team2")).alias("team")).distinct()
