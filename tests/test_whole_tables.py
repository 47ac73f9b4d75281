"""Long forms of the matrix, the crosstab and the scenarios leave no row out."""

from pyspark.sql import functions as F

from contestry.operators import records as R
from contestry.operators import scoring as SC
from contestry.operators import trends as T


def test_long_forms_hold_all_rows(tables):
    m = tables["matches"]
    n = m.count()
    assert T.squad_size_counts(tables["players"], m).agg(F.sum("contests")).first()[0] == n
    cells = R.head_to_head_cells(m, min_meetings=1)
    assert cells.count() == R.head_to_head(m).count() and not cells.where("win_pct IS NULL").count()
    assert R.head_to_head(m).agg(F.sum("meetings")).first()[0] == 2 * m.where("is_decided").count()


def test_opponents_are_the_sides_of_the_last_season(spark):
    rows = [(1, 1999, 10, 11, False), (1, 2000, 10, 12, False), (1, 2000, 13, 14, True), (2, 1998, 20, 21, False)]
    m = spark.createDataFrame(rows, "league int, season_year int, team1 int, team2 int, voided boolean")
    assert sorted(map(tuple, SC.active_sides(m).collect())) == [(1, 10), (1, 12), (2, 20), (2, 21)]


def test_totals_of_opponents_are_those_of_the_scenarios(spark):
    sides = spark.createDataFrame([(1, i) for i in (2, 3, 9, 10, 11, 100)] + [(2, 5), (2, 6), (3, 7)], "league int, opp long")
    pairs = [(a, b) for a in (2, 9, 10, 100, 77) for b in (3, 10, 11, 78)] + [(10, 10), (None, 2), (2, None)]
    rows = [(i, league, a, b, 1, "2000-01-01", "league", None, None) for i, (league, (a, b)) in enumerate((x, p) for x in (1, 2, 3, 4) for p in [*pairs, (5, 6), (7, 5)])]
    req = spark.createDataFrame(rows, "request_id long, league int, team_a long, team_b long, venue_id long, date string, stage string, toss_winner long, toss_decision string")
    each = SC.opponent_scenarios(req, sides).groupBy("base_id").agg(
        F.count("*").alias("scenarios"), F.sum("team_b").alias("sides"), F.min("scenario").alias("first_label"), F.max("scenario").alias("last_label")
    )
    totals = SC.opponent_scenarios(req, sides, totals=True)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, each.collect())) and each.count() > 40
