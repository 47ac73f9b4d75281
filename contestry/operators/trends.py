"""Scoring trends, margins, people and data-quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.stats import DIFF_Z
from contestry.functions.tails import mwu_exact_p, normal_two_sided_p, t_two_sided_p
from contestry.operators.ordering import average_rank, rank_values
from contestry.operators.records import count_if, count_rows

SCORED = "scores_usable AND first_innings_runs IS NOT NULL"


def scoring_by_season(m: DataFrame) -> DataFrame:
    """Season scoring with the exact median. Scores lie in 0–350 by contract, so the percentile
    state is a small histogram per season however many contests a season holds."""
    x = F.col("first_innings_runs")
    return m.where(SCORED).groupBy("season_year").agg(
        count_rows().alias("matches"),
        F.avg(x).alias("mean_first_innings"),
        F.percentile(x, F.lit(0.5)).alias("median_first_innings"),
        F.avg((x >= 200).cast("double")).alias("share_200_plus"),
        F.max(x).alias("max_first_innings"),
    )


def mann_whitney(df: DataFrame, value: str, is_a: Column, method: str = "auto") -> DataFrame:
    """U of group a, tie-corrected normal statistic, two-sided p.

    ``method`` is "exact" (no ties may occur in the null distribution), "asymptotic", or "auto": exact where
    there are no ties and one group has at most eight rows.

    Ranks come from the distinct values, so no row-level sort takes place.
    """
    r = rank_values(df.withColumn("_a", is_a), value, {"a": F.sum(F.when(F.col("_a"), 1).otherwise(0)).cast("long")})
    g = r.agg(
        F.sum(F.col("a") * average_rank()).alias("rank_sum"),
        F.sum("a").alias("n_a"),
        F.sum("n").alias("n"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
        F.max("n").alias("most"),
    )
    na, n = F.col("n_a").cast("double"), F.col("n").cast("double")
    nb = n - na
    u = F.col("rank_sum") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / F.when(sd > 0, sd)
    out = g.select(F.col("n_a"), (F.col("n") - F.col("n_a")).alias("n_b"), u.alias("u"), z.alias("z"), "most")
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"method is auto, exact or asymptotic, not {method!r}")
    tiny = F.lit(method == "exact") if method != "auto" else (F.col("most") == 1) & (F.least("n_a", "n_b") <= 8)
    exact = mwu_exact_p(F.when(tiny, F.col("u")), F.when(tiny, F.col("n_a")), F.when(tiny, F.col("n_b")))
    normal = F.when(F.col("z") <= 0, F.lit(1.0)).otherwise(normal_two_sided_p("z"))
    return out.withColumn("p_value", F.coalesce(exact, normal)).drop("most")


def era_scoring_test(m: DataFrame) -> DataFrame:
    """First-innings scores, new era against old: Welch, Mann–Whitney, interval and Cohen's d."""
    s = m.where(SCORED)
    new, x = F.col("impact_era"), F.col("first_innings_runs")
    g = s.agg(
        count_if(~new).alias("n_pre"), count_if(new).alias("n_post"),
        F.avg(F.when(~new, x)).alias("mean_pre"), F.avg(F.when(new, x)).alias("mean_post"),
        F.var_samp(F.when(~new, x)).alias("var_pre"), F.var_samp(F.when(new, x)).alias("var_post"),
        F.avg(F.when(~new, (x >= 200).cast("double"))).alias("share_200_pre"),
        F.avg(F.when(new, (x >= 200).cast("double"))).alias("share_200_post"),
    )
    va, vb = F.col("var_post") / F.col("n_post"), F.col("var_pre") / F.col("n_pre")
    se = F.sqrt(va + vb)
    diff = F.col("mean_post") - F.col("mean_pre")
    pooled = F.sqrt((F.col("var_post") + F.col("var_pre")) / 2)
    dof = F.pow(va + vb, 2) / (F.pow(va, 2) / (F.col("n_post") - 1) + F.pow(vb, 2) / (F.col("n_pre") - 1))
    mw = mann_whitney(s, "first_innings_runs", F.col("impact_era")).select("p_value").scalar()
    return g.select(
        "n_pre", "n_post", "mean_pre", "mean_post", diff.alias("diff"),
        (diff - DIFF_Z * se).alias("ci_low"), (diff + DIFF_Z * se).alias("ci_high"),
        F.when(pooled > 0, diff / F.when(pooled > 0, pooled)).alias("cohens_d"),
        (diff / se).alias("welch_t"), dof.alias("welch_dof"),
        "share_200_pre", "share_200_post",
    ).withColumn("welch_p", t_two_sided_p("welch_t", "welch_dof")).withColumn("mannwhitney_p", mw)


def margin_summary(m: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of the margin, revised targets left out. Margins are
    small integers by contract, which bounds the percentile state."""
    x = F.col("margin_value").cast("double")
    d = m.where("is_decided AND NOT dls_flag AND margin_type IS NOT NULL").groupBy("margin_type").agg(
        count_rows().alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max(x).alias("max"),
    )
    return d.select(
        "margin_type", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max",
    )


def closest_finishes(m: DataFrame, n: int = 10) -> DataFrame:
    """Ties first, then the narrowest wins by runs: a distributed top-k."""
    tie = F.col("result_type") == "tie"
    narrow = (F.col("margin_type") == "runs") & ~F.col("dls_flag")
    return (
        m.where(tie | narrow)
        .withColumn("closeness", F.when(tie, F.lit(0)).otherwise(F.col("margin_value")))
        .orderBy("closeness", "date", "match_id")
        .limit(n)
    )


def potm_leaderboard(m: DataFrame, players: DataFrame, top: int = 15) -> DataFrame:
    """Award counts with the sides the squad lists name. Awards are counted before the join's
    strings are built, and the list of sides is built for the top rows only."""
    awards = m.where(F.col("player_of_match").isNotNull()).select(
        "match_id", "season_year", F.col("player_of_match").alias("player")
    )
    j = awards.join(players.select("match_id", "player", "team"), ["match_id", "player"], "left")
    # A player listed on both sides counts twice, as the left join does.
    per_team = j.groupBy("player", "team").agg(
        count_rows().alias("c"), F.min("season_year").alias("f"), F.max("season_year").alias("l")
    )
    counts = per_team.groupBy("player").agg(
        F.sum("c").alias("awards"), F.min("f").alias("first"), F.max("l").alias("last")
    )
    best = counts.orderBy(F.desc("awards"), F.desc("last"), "player").limit(top)
    names = (
        per_team.join(best.select("player"), "player", "left_semi")
        .groupBy("player")
        .agg(F.array_join(F.array_sort(F.collect_set(F.col("team").cast("string"))), ", ").alias("teams"))
    )
    return best.join(names, "player", "left")


def appearances(players: DataFrame, m: DataFrame, top: int = 15) -> DataFrame:
    """Contests and seasons per player, by staged distinct aggregation, ties broken by name."""
    p = players.select("match_id", "team", "player").join(m.select("match_id", "season_year"), "match_id")
    per_match = p.groupBy("player", "match_id").agg(F.min("season_year").alias("s"))
    per_season = per_match.groupBy("player", "s").agg(count_rows().alias("c"))
    counts = per_season.groupBy("player").agg(F.sum("c").alias("matches"), count_rows().alias("seasons"))
    best = counts.orderBy(F.desc("matches"), "player").limit(top)
    teams = (
        players.join(best.select("player"), "player", "left_semi")
        .groupBy("player")
        .agg(F.array_join(F.array_sort(F.collect_set(F.col("team").cast("string"))), ", ").alias("teams"))
    )
    return best.join(teams, "player")


def squad_sets(players: DataFrame) -> DataFrame:
    """(match_id, team, squad): a squad has at most a dozen names by contract."""
    return players.groupBy("match_id", "team").agg(F.array_sort(F.collect_set("player")).alias("squad"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def squad_continuity(players: DataFrame, m: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of consecutive squads of a side within a season.

    A day's squads are ordered within that (side, day). The first squad of a day meets the last
    squad of the side's previous day, which is looked up in a table with one row per side and day.
    So no task orders the whole history of a busy side.
    """
    order = m.select("match_id", "date", "season_year")
    s = squad_sets(players).join(order, "match_id").withColumn("_blk", F.col("date"))
    blk = Window.partitionBy("team", "_blk").orderBy("date", "match_id")
    s = s.withColumn("_prev", F.lag(F.struct("squad", "season_year")).over(blk))
    last = s.groupBy("team", "_blk").agg(
        F.max_by(F.struct("squad", "season_year"), F.struct("date", "match_id")).alias("_last")
    )
    by_team = Window.partitionBy("team").orderBy("_blk")
    last = last.select("team", "_blk", F.lag("_last").over(by_team).alias("_before"))
    j = s.join(last, ["team", "_blk"]).withColumn("_p", F.coalesce("_prev", "_before"))
    pairs = j.where(F.col("_p.season_year") == F.col("season_year"))
    return pairs.groupBy("team", "season_year").agg(
        F.avg(jaccard(F.col("_p.squad"), F.col("squad"))).alias("mean_jaccard"), count_rows().alias("transitions")
    )


def officials_table(m: DataFrame, min_matches: int = 20) -> DataFrame:
    """Per official over both umpire columns: distinct contests, span, batting-first win rate."""
    long = m.select(
        "match_id", "season_year", "bat_first_won", F.explode(F.array("umpire1", "umpire2")).alias("official")
    ).where(F.col("official").isNotNull())
    # (official, contest) first, with how many of the two posts the official held.
    per = long.groupBy("official", "match_id").agg(
        F.min("season_year").alias("s"), count_rows().alias("posts"),
        F.max(F.col("bat_first_won").cast("double")).alias("bfw"),
    )
    w = F.when(F.col("bfw").isNotNull(), F.col("posts"))
    return (
        per.groupBy("official")
        .agg(
            count_rows().alias("matches"), F.min("s").alias("first"), F.max("s").alias("last"),
            (F.sum(w * F.col("bfw")) / F.sum(w)).alias("bat_first_win_rate"),
        )
        .where(F.col("matches") >= min_matches)
    )


# -- quality ----------------------------------------------------------------------------------


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    agg = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "nulls")


def constant_columns(raw: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Smallest and largest text of each column that should hold one value."""
    agg = raw.agg(*[F.struct(F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi")).alias(c) for c in expected])
    long = agg.unpivot([], list(expected), "column", "v")
    return long.select("column", F.col("v.lo").alias("lo"), F.col("v.hi").alias("hi"), (F.col("v.lo") == F.col("v.hi")).alias("is_constant"))


def season_rollup(m: DataFrame) -> DataFrame:
    return m.groupBy("season_year").agg(
        count_rows().alias("matches"), count_if(F.col("is_decided")).alias("decided"),
        count_if(F.col("result_type") == "tie").alias("ties"),
        count_if(F.col("result_type") == "no result").alias("no_results"),
        F.min("date").alias("first_match"), F.max("date").alias("last_match"),
        F.avg(F.col("team1_bats_first").cast("double")).alias("team1_bats_first_share"),
    )


def squad_size_crosstab(players: DataFrame, m: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Contests per season and first-side squad size."""
    first = m.select("match_id", F.col("team1").alias("team"), "season_year")
    n = players.groupBy("match_id", "team").agg(count_rows().alias("size"))
    per = first.join(n, ["match_id", "team"], "left").fillna(0, ["size"])
    return per.groupBy("season_year").pivot("size", list(sizes)).agg(count_rows()).fillna(0)


def squad_size_counts(players: DataFrame, m: DataFrame) -> DataFrame:
    """(season_year, size, contests): the crosstab in long form, with every first-side squad size that occurs."""
    first = m.select("match_id", F.col("team1").alias("team"), "season_year")
    n = players.groupBy("match_id", "team").agg(count_rows().alias("size"))
    per = first.join(n, ["match_id", "team"], "left").fillna(0, ["size"])
    return per.groupBy("season_year", "size").agg(count_rows().alias("contests"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(count_rows().alias("rows"))


def distinct_counts(df: DataFrame, named: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct values over the union of columns: deduplicated per (name, value) before counting,
    so no task holds the values of a column."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("name"), F.col(c).cast("string").alias("v")) for k, cs in named.items() for c in cs]
    )
    long = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("v").isNotNull())
    return long.groupBy("name", "v").agg(F.lit(1).alias("x")).groupBy("name").agg(count_rows().alias("distinct_values"))


def data_dictionary(df: DataFrame) -> DataFrame:
    """Column, type and one example (the smallest non-null value, so that it is reproducible)."""
    types = dict(df.dtypes)
    agg = df.agg(*[F.min(F.col(c)).cast("string").alias(c) for c in df.columns])
    long = agg.unpivot([], df.columns, "column", "example")
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return long.select("column", kinds[F.col("column")].alias("dtype"), F.substring("example", 1, 40).alias("example"))
