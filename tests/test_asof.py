"""Leakage: later contests and contests of the same day must not move a feature."""

import pytest
from pyspark.sql import functions as F

from contestry.operators import asof as A
from contestry.operators import elo as E

CUT = "1998-01-01"
COLS = [c for c in A.feature_names("post_toss") if c != "elo_diff"]


def snapshot(df, cols, where):
    return {r.match_id: tuple(None if v is None else round(v, 9) for v in r[1:]) for r in df.where(where).select("match_id", *cols).collect()}


def test_future_changes_leave_the_past_alone(tables):
    m, players = tables["matches"], tables["players"]
    late = F.col("date") >= CUT
    flipped = m.withColumns(
        {
            "winner": F.when(late & F.col("is_decided"), F.when(F.col("winner") == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))).otherwise(F.col("winner")),
            "team1_runs": F.when(late, F.col("team1_runs") + 50).otherwise(F.col("team1_runs")),
            "first_innings_runs": F.when(late, F.col("first_innings_runs") + 50).otherwise(F.col("first_innings_runs")),
        }
    )
    a = snapshot(A.pair_features(m, players), COLS, F.col("date") <= CUT)
    b = snapshot(A.pair_features(flipped, players), COLS, F.col("date") <= CUT)
    c = snapshot(A.pair_features(m.where(F.col("date") <= CUT), players), COLS, F.col("date") <= CUT)
    assert a == b == c and len(a) > 300


def test_same_day_isolation(tables):
    m = tables["matches"]
    day = m.groupBy("league", "day").count().orderBy(F.desc("count"), "day", "league").first()
    here = (F.col("league") == day.league) & (F.col("day") == day.day)
    one = m.where(here).agg(F.min("match_id")).first()[0]
    alone = m.where(~here | (F.col("match_id") == one))
    cols = [c for c in COLS if not c.startswith("xi_")]
    a = snapshot(A.pair_features(m), cols, F.col("match_id") == one)
    b = snapshot(A.pair_features(alone), cols, F.col("match_id") == one)
    assert a == b and day["count"] > 1


def test_swap_negates_only_antisymmetric(tables):
    f = A.pair_features(tables["matches"]).limit(50).cache()
    s = A.swapped(f, "pre_toss")
    j = f.alias("f").join(s.alias("s"), "match_id")
    for c in A.feature_names("pre_toss", -1)[1:]:
        assert j.where(F.abs(F.col(f"f.{c}") + F.col(f"s.{c}")) > 1e-12).count() == 0


def test_feature_guard():
    A.guard_inputs(["elo_diff"], "pre_toss")
    with pytest.raises(ValueError):
        A.guard_inputs(["winner"], "pre_toss")
    with pytest.raises(ValueError):
        A.guard_inputs(["a_won_toss"], "pre_toss")


def test_small_history(spark):
    """One side: a win, then no result two days later, asked three days after that."""
    rows = [(1, 10, "complete", True, 1, True, 180, 150), (2, 12, "no result", False, None, False, 20, 0)]
    m = spark.createDataFrame(rows, "match_id long, day int, result_type string, is_decided boolean, winner long, scores_usable boolean, team1_runs long, team2_runs long").selectExpr(
        "*", "0L AS league", "1L AS team1", "2L AS team2", "2020L AS season_year", "1L AS venue_id", "false AS team1_home", "false AS team2_home"
    )
    ask = spark.sql("SELECT 9L AS match_id, 0L AS league, 15 AS day, 2020L AS season_year, 1L AS venue_id, 1L AS team")
    r = A.form_state(A.side_events(m), ask).where("team = 1 AND day = 15").first()
    assert r.form5 == pytest.approx(2 / 3) and r.runs_for10 == 180 and r.rest_days == 3 and r.season_games == 1


def fold(rows, p: E.EloParams):
    """Plain sequential ratings of one league."""
    from collections import defaultdict
    from itertools import groupby
    from math import log

    rating, games, season, out = {}, defaultdict(int), None, {}
    for day, batch in groupby(sorted(rows, key=lambda r: (r["day"], r["match_id"])), key=lambda r: r["day"]):
        batch = list(batch)
        if batch[0]["season_year"] != season:
            if season is not None:
                rating = {t: r - p.season_regression * (r - p.initial) for t, r in rating.items()}
            season, games = batch[0]["season_year"], defaultdict(int)
        get = lambda t: rating.get(t, p.initial)
        moves = defaultdict(float)
        for r in batch:
            a, b = r["team1"], r["team2"]
            out[r["match_id"]] = (get(a), get(b))
            if not (r["is_decided"] or r["result_type"] == "tie"):
                continue
            home = p.home_bonus * (int(r["team1_home"]) - int(r["team2_home"]))
            want = 1 / (1 + 10 ** (-(get(a) - get(b) + home) / p.scale))
            s = 0.5 if r["result_type"] == "tie" else float(r["winner"] == a)
            mult = 1.0
            if p.use_margin and r["is_decided"] and not r["dls_flag"]:
                units = r["margin_value"] / (10 if r["margin_type"] == "runs" else 2)
                lead = get(a) - get(b) if s == 1 else get(b) - get(a)
                mult = log(units + 1) * 2.2 / (0.001 * lead + 2.2) if units > 0 else 1.0
            boost = lambda t: 1 + p.early_season_k_boost * max(0, 1 - games[t] / 7)
            d = p.k * (boost(a) + boost(b)) / 2 * mult * (s - want)
            moves[a] += d
            moves[b] -= d
        for r in batch:
            if r["is_decided"] or r["result_type"] == "tie":
                games[r["team1"]] += 1
                games[r["team2"]] += 1
        for t, d in moves.items():
            rating[t] = get(t) + d
    return out


@pytest.mark.parametrize("block", [10, 3])
def test_ratings_equal_a_sequential_fold(tables, block):
    m = tables["matches"]
    params = [E.EloParams(), E.EloParams(k=32, use_margin=False, early_season_k_boost=0.5, season_regression=0.1)]
    ratings, games = E.solve(m, params, seasons_per_block=block)
    rows = [r.asDict() for r in m.collect()]
    got = {(r.cand, r.match_id): (r.r1, r.r2) for r in E._deltas(games, ratings).collect()}
    for i, p in enumerate(params):
        for lg in {r["league"] for r in rows}:
            for mid, want in fold([r for r in rows if r["league"] == lg], p).items():
                assert got[i, mid] == pytest.approx(want, abs=1e-6)


def test_fixture_rating_equals_training_rating(tables):
    """A contest's rating as a fixture on its own day is the rating it had in training."""
    m = tables["matches"]
    ratings, games = E.solve(m)
    asks = m.where("season_year >= 2000")
    a = E.rating_as_of(m, games, ratings, asks)
    j = a.alias("a").join(ratings.alias("r"), ["league", "team", "day"])
    assert j.where(F.abs(F.col("a.rating") - F.col("r.rating")) > 1e-6).count() == 0 and j.count() > 100


def test_ratings_are_walked_in_blocks_of_any_size(tables, monkeypatch):
    """Every contest is walked once, with no round over all of them; small blocks hand the same ratings on as the fixed point finds."""
    m = tables["matches"].where("league < 2")
    params = [E.EloParams(), E.EloParams(k=32, early_season_k_boost=0.5, season_regression=0.1)]
    want, games = E.fixed_point(m, params)
    want = {(r.cand, r.league, r.team, r.day): (r.rating, r.d, r.sidx) for r in want.collect()}
    old = {(r.cand, r.match_id): (r.r1, r.r2, r.delta) for r in E._deltas(games, E.fixed_point(m, params)[0]).collect()}
    monkeypatch.setattr(E, "_round", None)
    for block in (E.BLOCK, 60):
        ratings, walked = E.solve(m, params, block=block)
        got = {(r.cand, r.league, r.team, r.day): (r.rating, r.d, r.sidx) for r in ratings.collect()}
        assert got.keys() == want.keys() and ratings.count() == len(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
        rows = {(r.cand, r.match_id): (r.r1, r.r2, r.delta) for r in walked.collect()}
        assert rows.keys() == old.keys() and all(rows[k] == pytest.approx(old[k], abs=1e-7) for k in old)
    blocks = E._blocks(m, 10, 60)
    sizes = m.join(blocks, ["league", "day"]).groupBy("league", "block").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 60 + m.groupBy("league", "day").count().agg(F.max("count")).first()[0]


def test_ratings_of_no_contests(tables):
    ratings, games = E.solve(tables["matches"].where("false"))
    assert ratings.count() == games.count() == 0
