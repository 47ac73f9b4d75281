"""Margin-aware ratings, walked block by block through the days.

Ratings are sequential by definition: a contest's update needs both sides' ratings of the days before. Contests of a day
do not see each other, so a day is worked as arrays. A league's days are cut into blocks of bounded size; all leagues and
candidates walk a block at once, each in its own task, and hand the ratings of their sides on as a table of a row a side.
A task holds a block and those rows, never a league, and every contest is walked once: the ratings are those of a
sequential fold, not an approximation. The blocks of a league follow each other, so at any time as many tasks work as there
are leagues times candidates.

A walked contest carries both ratings before its day and its update, so what reads them joins nothing. The ratings of sides by
day are a view of the same rows.

``fixed_point`` finds the same ratings without an order of the work: from any guess of the ratings before each
day, every update follows in parallel, and the running sum of the updates gives the next guess. Every round shuffles
all contests, some two dozen times, so it serves as a check of the walk.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from contestry.session import Stage

# Search grid of the rating parameters.
ELO_GRID = {
    "k": [5, 7, 10, 15, 20, 25, 32, 40],
    "home_bonus": [0, 15, 30, 50, 75],
    "season_regression": [0.0, 0.1, 0.2, 0.33, 0.5],
    "use_margin": [False, True],
}


@dataclass(frozen=True)
class EloParams:
    initial: float = 1500.0
    scale: float = 400.0
    k: float = 20.0
    home_bonus: float = 30.0
    season_regression: float = 0.33
    use_margin: bool = True
    early_season_k_boost: float = 0.0


def candidates(grid: dict[str, Sequence], base: EloParams = EloParams()) -> list[EloParams]:
    return [EloParams(**{**asdict(base), **dict(zip(grid, v))}) for v in itertools.product(*grid.values())]


def season_index(m: DataFrame) -> DataFrame:
    """(league, season_year, sidx): how many season changes the league has seen."""
    w = Window.partitionBy("league").orderBy("season_year")
    return m.select("league", "season_year").distinct().withColumn("sidx", F.row_number().over(w) - 1)


def games_before(m: DataFrame) -> DataFrame:
    """(league, team, season_year, day, played): rated contests of the season on earlier days."""
    from contestry.operators.asof import prior_sums

    rated = "CAST(is_decided OR result_type = 'tie' AS int) AS played"
    ev = m.selectExpr("league", "season_year", "day", rated, "explode(array(team1, team2)) AS team")
    return prior_sums(ev, ["league", "team", "season_year"], ["played"])


def rated_games(m: DataFrame, params: Sequence[EloParams]) -> DataFrame:
    """One row per (candidate, contest) with every part of the update that the ratings do not touch.

    Contests without a result stay in, unrated, so that their sides get a rating for the day.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("cand"), *[F.lit(v).alias(f"p_{k}") for k, v in asdict(p).items()]) for i, p in enumerate(params)])
    g = m.join(season_index(m), ["league", "season_year"])
    if any(p.early_season_k_boost for p in params):
        n = games_before(m)
        for i in (1, 2):
            g = g.join(n.selectExpr("league", "season_year", "day", f"team AS team{i}", f"played AS played{i}"), ["league", "season_year", "day", f"team{i}"])
    else:
        g = g.selectExpr("*", "7 AS played1", "7 AS played2")
    boost = "(1 + p_early_season_k_boost * greatest(0D, 1 - played{} / 7D))"
    g = g.withColumn("_p", F.explode(grid)).select("*", "_p.*")
    return g.selectExpr(
        "cand", "league", "match_id", "day", "season_year", "sidx", "team1", "team2",
        "p_initial AS initial", "p_scale AS scale", "1 - p_season_regression AS decay",
        "p_home_bonus * (CAST(team1_home AS int) - CAST(team2_home AS int)) AS home",
        "is_decided OR result_type = 'tie' AS rated",
        "CASE WHEN result_type = 'tie' THEN 0.5D WHEN winner = team1 THEN 1D ELSE 0D END AS score",
        f"p_k * ({boost.format(1)} + {boost.format(2)}) / 2 AS k",
        """CASE WHEN p_use_margin AND is_decided AND NOT coalesce(dls_flag, false) THEN
             CASE margin_type WHEN 'runs' THEN margin_value / 10D WHEN 'wickets' THEN margin_value / 2D END END AS units""",
    )


def _deltas(games: DataFrame, ratings: DataFrame | None) -> DataFrame:
    """Both pre-contest ratings and side 1's update for every contest; walked contests carry them."""
    g = games
    if "delta" in games.columns:
        return g
    by_contest = ratings is not None and "ids" in ratings.columns
    if by_contest:
        x = ratings.select("cand", "rating", F.explode("ids").alias("x")).groupBy("cand", "x.match_id")
        g = g.join(x.agg(*[F.max(F.when(F.col("x.side") == i, F.col("rating"))).alias(f"r{i}") for i in (1, 2)]), ["cand", "match_id"])
    for i in (1, 2):
        if by_contest:
            continue
        if ratings is None:
            g = g.withColumn(f"r{i}", F.col("initial"))
        else:
            r = ratings.selectExpr("cand", "league", f"team AS team{i}", "day", f"rating AS r{i}")
            g = g.join(r, ["cand", "league", f"team{i}", "day"])
    expected = "1 / (1 + pow(10D, -(r1 - r2 + home) / scale))"
    lead = "CASE WHEN score = 1 THEN r1 - r2 ELSE r2 - r1 END"
    mult = f"CASE WHEN units > 0 THEN ln(units + 1) * 2.2D / (0.001D * ({lead}) + 2.2D) ELSE 1D END"
    return g.withColumn("delta", F.expr(f"CASE WHEN rated THEN k * ({mult}) * (score - {expected}) ELSE 0D END"))


def _round(games: DataFrame, ratings: DataFrame | None, carry: DataFrame | None, s0: int) -> DataFrame:
    """Next guess of (cand, league, team, day) → rating, with the previous one and the day's update."""
    keys = ["cand", "league", "team"]
    d = _deltas(games, ratings)
    sums = (
        d.selectExpr(
            "cand", "league", "day", "sidx", "initial", "decay",
            "explode(array(struct(team1 AS team, delta AS d, r1 AS r, struct(match_id, 1 AS side) AS id),"
            " struct(team2 AS team, -delta AS d, r2 AS r, struct(match_id, 2 AS side) AS id))) AS s",
        )
        .select("cand", "league", "day", "sidx", "initial", "decay", "s.*")
        .repartition(*keys)
        .groupBy(*keys, "day")
        .agg(
            F.sum("d").alias("d"), F.max("r").alias("prev"), F.collect_list("id").alias("ids"),
            *[F.max(c).alias(c) for c in ("sidx", "initial", "decay")],
        )
    )
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("d") * F.pow("decay", -(F.col("sidx") - s0))).over(before), F.lit(0.0))
    if carry is not None:
        sums = sums.join(carry, keys, "left")
        start = F.coalesce("dev", F.lit(0.0))
    else:
        start = F.lit(0.0)
    rating = F.col("initial") + F.pow("decay", F.col("sidx") - s0) * (start + moved)
    return sums.select(*keys, "day", "sidx", "decay", "d", "prev", "ids", rating.alias("rating"))


def _carry(final: DataFrame, carry: DataFrame | None, s0: int, s_next: int) -> DataFrame:
    """Deviation from the mean each side takes into the next block of seasons."""
    keys = ["cand", "league", "team"]
    w = F.sum(F.col("d") * F.pow("decay", F.lit(s_next) - F.col("sidx")))
    out = final.groupBy(*keys).agg(w.alias("moved"), F.max("decay").alias("_decay"))
    if carry is None:
        return out.select(*keys, F.col("moved").alias("dev"))
    j = carry.join(out.select(*keys, "moved"), keys, "full")
    # A side that sat out still moves back to the mean with every season.
    rates = final.select("cand", "decay").distinct()
    return j.join(rates, "cand").select(
        *keys,
        (F.coalesce("moved", F.lit(0.0)) + F.coalesce("dev", F.lit(0.0)) * F.pow("decay", F.lit(s_next - s0))).alias("dev"),
    )


def fixed_point(m: DataFrame, params: Sequence[EloParams] = (EloParams(),), tol: float = 1e-9, max_rounds: int = 500, seasons_per_block: int = 10):
    """(cand, league, team, day, rating): the rating of every side before each of its days.

    Seasons are solved in blocks, so that the number of rounds follows the contests of a side within
    a block and not its whole history. The loop ends when no rating moves by more than ``tol``, else it raises.
    """
    if any(not 0 <= p.season_regression < 1 for p in params):
        raise ValueError("season_regression must lie in [0, 1)")
    spark = m.sparkSession
    stage = Stage(spark, "ratings")
    games = stage.write(rated_games(m, params), "games")
    n_seasons = games.agg(F.max("sidx")).first()[0] + 1  # one number
    carry, parts = None, []
    for s0 in range(0, n_seasons, seasons_per_block):
        s1 = min(n_seasons, s0 + seasons_per_block)
        block = games.where((F.col("sidx") >= s0) & (F.col("sidx") < s1))
        ratings = None
        for i in range(max_rounds):
            # Two slots in turn: a round reads the one that the previous round wrote.
            ratings = stage.write(_round(block, ratings, carry, s0), f"block{s0}-{i % 2}")
            moved = ratings.agg(F.max(F.abs(F.col("rating") - F.col("prev")))).first()[0]  # one number
            if (moved or 0.0) <= tol:
                break
        else:
            raise RuntimeError("ratings did not settle")
        parts.append(ratings)
        if s1 < n_seasons:
            carry = stage.write(_carry(ratings, carry, s0, s1), f"carry{s1}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("cand", "league", "team", "day", "sidx", "d", "rating"), games


BLOCK = 1 << 19  # contests in a block, a day at least
_WALKED = {"r1": pa.float64(), "r2": pa.float64(), "delta": pa.float64(), "d1": pa.float64(), "d2": pa.float64(), "own1": pa.bool_(), "own2": pa.bool_()}


def _blocks(m: DataFrame, seasons: int, size: int) -> DataFrame:
    """(league, day, block): whole days in time order, at most ``size`` contests (or one day) and ``seasons`` seasons a block."""
    days = m.groupBy("league", "day").agg(F.count(F.lit(1)).alias("n"), F.max("season_year").alias("season_year"))
    days = days.join(season_index(m), ["league", "season_year"]).withColumn("part", F.expr(f"sidx DIV {seasons}"))
    before = F.sum("n").over(Window.partitionBy("league", "part").orderBy("day")) - F.col("n")  # a row a league and day
    cut = days.select("league", "day", "part", F.floor(before / size).alias("cut"))
    return cut.select("league", "day", (F.dense_rank().over(Window.partitionBy("league").orderBy("part", "cut")) - 1).alias("block"))


def _floats(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).cast(pa.float64()).to_numpy()  # null: not a number


def _walk(rows: pa.Table, state: pa.Table) -> pa.Table:
    """One block of one candidate and league, from its sides' ratings at the block's start: both ratings and the update of
    every contest, the sum of either side's updates of the day, and which row stands for a side's day."""
    if not rows.num_rows:  # a league that has no such block
        return pa.table([pa.array([], t) for t in (*rows.schema.types, *_WALKED.values())], names=[*rows.schema.names, *_WALKED])
    rows = rows.sort_by([("day", "ascending"), ("match_id", "ascending")])
    n, known = rows.num_rows, pa.concat_arrays([c for x in ("team1", "team2") for c in rows.column(x).chunks]).dictionary_encode()
    sides, names = known.indices.to_numpy().astype(np.int64).reshape(2, n), known.dictionary
    initial, decay, scale = (rows.column(c)[0].as_py() for c in ("initial", "decay", "scale"))
    day, season = (rows.column(c).to_numpy() for c in ("day", "sidx"))
    home, score, k, units = (_floats(rows, c) for c in ("home", "score", "k", "units"))
    rated = rows.column("rated").fill_null(False).to_numpy()
    away, now = np.zeros(len(names)), int(season[0])  # how far a side is from the mean
    if state.num_rows:
        at = pc.index_in(state.column("team"), value_set=names)
        old = state.filter(at.is_valid())
        away[at.drop_null().to_numpy()] = old.column("away").to_numpy() * decay ** (now - old.column("sidx").to_numpy()).astype(float)
    ratings, delta, sums, moved = np.empty((2, n)), np.empty(n), np.empty((2, n)), np.zeros(len(names))
    edges = np.flatnonzero(np.diff(day, prepend=day[0] - 1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n], strict=True):
        if (turn := int(season[a])) != now:
            away, now = away * decay ** float(turn - now), turn
        both = sides[:, a:b]
        ratings[:, a:b] = before = away[both]
        gap, won = before[0] - before[1], score[a:b]
        with np.errstate(invalid="ignore", over="ignore"):
            expected = 1 / (1 + 10.0 ** (-(gap + home[a:b]) / scale))
            wide = units[a:b] > 0
            margin = np.where(wide, np.log(np.where(wide, units[a:b], 0) + 1) * 2.2 / (0.001 * np.where(won == 1, gap, -gap) + 2.2), 1.0)
            delta[a:b] = np.where(rated[a:b], k[a:b] * margin * (won - expected), 0.0)
        gain = np.nan_to_num(delta[a:b])  # what is unknown moves nobody
        np.add.at(moved, both[0], gain)
        np.subtract.at(moved, both[1], gain)
        sums[:, a:b] = moved[both]
        away[both] = before + moved[both]
        moved[both] = 0.0
    first, on = np.zeros(2 * n, bool), np.repeat(np.arange(len(edges)), np.diff([*edges, n]))
    first[np.unique((on * len(names) + sides).ravel(), return_index=True)[1]] = True
    made = [*(ratings + initial), pa.array(delta, from_pandas=True), *sums, *first.reshape(2, n)]
    for (name, kind), column in zip(_WALKED.items(), made, strict=True):
        rows = rows.append_column(name, pa.array(column, kind))
    return rows


def _sides(games: DataFrame, *columns: str) -> DataFrame:
    """(columns, team, d, rating) of walked contests, a row a side and day, where the contests lie."""
    both = ", ".join(f"struct(team{i} AS team, d{i} AS d, r{i} AS rating, own{i} AS own)" for i in (1, 2))
    return games.selectExpr(*columns, f"explode(filter(array({both}), x -> x.own)) AS s").select(*columns, "s.team", "s.d", "s.rating")


def solve(m: DataFrame, params: Sequence[EloParams] = (EloParams(),), seasons_per_block: int = 10, block: int = BLOCK):
    """(cand, league, team, day, sidx, d, rating), the rating of every side before each of its days and the sum of the
    day's updates; and the contests with both ratings and side 1's update."""
    if any(not 0 <= p.season_regression < 1 for p in params):
        raise ValueError("season_regression must lie in [0, 1)")
    spark, stage = m.sparkSession, Stage(m.sparkSession, "ratings")
    days = stage.write(_blocks(m, seasons_per_block, block), "days")  # so that its size is known
    games = rated_games(m, params).join(days, ["league", "day"])
    columns = [c for c in games.columns if c != "block"]
    games = stage.write(games.repartition("league", "block"), "games", "block")
    keys, last = ["cand", "league"], days.agg(F.max("block")).first()[0]  # one number
    last = -1 if last is None else last
    walks = max(1, len(params) * days.select("league").distinct().count())
    # Four times as many tasks as walks hold few walks each.
    spread = lambda df: df.repartition(4 * walks, *keys).groupBy(*keys)
    schema = StructType([*games.select(*columns).schema, *[StructField(c, BooleanType() if t == pa.bool_() else DoubleType()) for c, t in _WALKED.items()]])
    after = lambda df: _sides(df, *keys, "day", "sidx", "initial").selectExpr(*keys, "team", "day", "sidx", "rating + d - initial AS away")
    known = after(spark.createDataFrame([], schema))
    for at in range(last + 1):
        part = games.where(F.col("block") == at).select(*columns)
        walked = stage.write(spread(part).cogroup(spread(known)).applyInArrow(_walk, schema), f"walked-{at}")
        if at < last:
            x = known.unionByName(after(walked)).groupBy(*keys, "team").agg(F.max(F.struct("day", "sidx", "away")).alias("x"))
            known = stage.write(x.select(*keys, "team", "x.*"), f"sides-{at % 2}")
    if last < 0:
        walked = spark.createDataFrame([], schema)
    else:
        walked = spark.read.schema(schema).parquet(*[f"{stage.root}/walked-{at}" for at in range(last + 1)])
    return _sides(walked, *keys, "day", "sidx").select(*keys, "team", "day", "sidx", "d", "rating"), walked


def rating_as_of(m: DataFrame, games: DataFrame, ratings: DataFrame, asks: DataFrame) -> DataFrame:
    """(league, team, day, rating) for fixtures, from history strictly before each fixture's day.

    ``ratings`` holds one candidate. Every fixture stands alone: it moves back to the mean for the
    season changes that history shows before its day, and once more if its own season is new.
    """
    p = games.select("initial", "decay").first()  # two numbers
    sides = asks.select("league", "day", "season_year", F.explode(F.array("team1", "team2")).alias("team")).distinct()
    after = ratings.select("league", "team", "day", F.struct("sidx", (F.col("rating") + F.col("d")).alias("post")).alias("_s"))
    spine = after.unionByName(sides.select("league", "team", "day"), allowMissingColumns=True)
    spine = spine.groupBy("league", "team", "day").agg(F.max("_s").alias("_s"))
    before = Window.partitionBy("league", "team").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = spine.select("league", "team", "day", F.last("_s", ignorenulls=True).over(before).alias("s"))
    seen = m.join(season_index(m), ["league", "season_year"]).groupBy("league", "day").agg(F.max(F.struct("sidx", "season_year")).alias("_l"))
    days = seen.unionByName(asks.select("league", "day").distinct(), allowMissingColumns=True)
    days = days.groupBy("league", "day").agg(F.max("_l").alias("_l"))
    lw = Window.partitionBy("league").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("league", "day", F.last("_l", ignorenulls=True).over(lw).alias("l"))
    x = sides.join(last, ["league", "team", "day"]).join(days, ["league", "day"])
    steps = F.col("l.sidx") - F.col("s.sidx") + F.when(F.col("l.season_year") == F.col("season_year"), 0).otherwise(1)
    rating = F.when(F.col("s").isNull(), F.lit(p.initial)).otherwise(
        F.lit(p.initial) + F.pow(F.lit(p.decay), steps) * (F.col("s.post") - F.lit(p.initial))
    )
    return x.select("league", "team", "day", rating.alias("rating"))


def history(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating history: one row per side per rated contest."""
    d = _deltas(games.where("rated"), ratings)
    return d.selectExpr(
        "cand", "match_id", "league", "day", "season_year",
        "explode(array(struct(team1 AS team, r1 AS rating_before, delta AS delta), struct(team2 AS team, r2 AS rating_before, -delta AS delta))) AS s",
    ).select("cand", "match_id", "league", "day", "season_year", "s.*")


def current(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """(league, team, rating) after all contests, moved back to the mean for every season since."""
    sides = history(games, ratings).select("cand", "league", "team", "season_year", "day", "rating_before", "delta")
    spans = games.select("cand", "league", "season_year", "sidx", "initial", "decay").distinct()
    last_season = spans.groupBy("cand", "league").agg(F.max("sidx").alias("_s"))
    daily = sides.groupBy("cand", "league", "team", "season_year", "day").agg(
        F.max("rating_before").alias("r"), F.sum("delta").alias("d")
    )
    last = daily.groupBy("cand", "league", "team").agg(F.max_by(F.struct("season_year", F.expr("r + d AS post")), "day").alias("x"))
    last = last.select("cand", "league", "team", "x.*").join(spans, ["cand", "league", "season_year"]).join(last_season, ["cand", "league"])
    return last.select("cand", "league", "team", F.expr("initial + pow(decay, _s - sidx) * (post - initial) AS rating"))


def leaders(games: DataFrame, ratings: DataFrame, top: int = 10) -> DataFrame:
    return current(games, ratings).orderBy(F.desc("rating"), "league", "team").limit(top)
