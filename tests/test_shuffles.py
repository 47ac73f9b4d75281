"""What is shuffled: the contests and their texts must not travel more than the work needs."""

from contextlib import redirect_stdout
from io import StringIO

from contestry.sources import contests as S
from contestry.sources import rawtext as RT


def plan_of(df):
    text = StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_texts_and_stages_come_without_a_shuffle(spark, sf, tables):
    assert "Exchange hashpartitioning" not in plan_of(RT.clean_text(spark, sf))
    assert "Exchange hashpartitioning" not in plan_of(tables["matches"].select("match_id", "stage", "season_champion"))


def test_rows_in_order_and_home_flags_stay_where_they_lie(spark, sf, tables):
    from contestry.operators import cleaning as C

    k, m = RT.knowledge(spark, sf), tables["matches"]
    home = C.with_home(m.drop("team1_home", "team2_home"), k.spells, k.neutral)
    assert "Exchange hashpartitioning(match_id" not in plan_of(home) and "SortMergeJoin" not in plan_of(home)
    sides = home.selectExpr("match_id", "explode(array(struct(team1 AS team, team1_home AS is_home), struct(team2 AS team, team2_home AS is_home))) AS s").select("match_id", "s.*")
    flags = C.home_flags(m, k.spells, k.neutral)
    assert sides.exceptAll(flags).count() == flags.exceptAll(sides).count() == 0 and sides.where("is_home").count() > 0
    numbered = C.with_match_id(m.drop("match_id"), ["venue", "stage"])
    assert "Exchange hashpartitioning(day" not in plan_of(numbered) and "SortMergeJoin" not in plan_of(numbered)
    assert "Exchange hashpartitioning" not in plan_of(RT.raw_text(spark, sf, ["league"]))


def test_line_items_are_read_once(spark, sf):
    plan = plan_of(S.squads(spark, sf))
    assert plan.count("lineitem.parquet") == 1


def test_listed_squads_are_the_players(spark, sf, tables):
    rows = tables["players"].groupBy("match_id", "team").agg({"player": "count", "slot_no": "max"})
    assert rows.where("`count(player)` <> `max(slot_no)`").count() == 0
    assert rows.count() == 2 * tables["matches"].count()


def test_contests_are_shuffled_once_a_state(tables):
    from contestry.operators import asof as A

    plan = plan_of(A.side_snapshots(tables["matches"]))
    assert plan.count("Exchange") == plan.count("hashpartitioning(league") + plan.count("BroadcastExchange") == 1 + plan.count("BroadcastExchange")
    plan = plan_of(A.pair_features(tables["listed"], tables["players"]).select("match_id", "form10_diff", "h2h_edge", "xi_potm_diff", "venue_first_innings"))
    assert plan.count("Exchange hashpartitioning") <= 7  # by side, pair, player, and by contest those three and the contests


def test_squads_from_rows_or_lists(tables):
    from contestry.operators import asof as A

    cols = ["match_id", "team", "xi_experience", "xi_potm", "xi_debutants", "xi_continuity"]
    lists = A.squad_state(tables["listed"], tables["players"]).select(cols)
    rows = A.squad_state(tables["matches"], tables["players"]).select(cols)
    assert lists.exceptAll(rows).count() == rows.exceptAll(lists).count() == 0 and rows.count() > 4000


def test_a_rating_round_shuffles_contests_once_a_way(tables):
    from contestry.operators import elo as E

    games = E.rated_games(tables["matches"], (E.EloParams(),)).localCheckpoint()
    first = E._round(games, None, None, 0).localCheckpoint()
    assert plan_of(E._round(games, first, None, 0)).count("Exchange hashpartitioning") <= 3
