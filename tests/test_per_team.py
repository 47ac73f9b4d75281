"""Statistics of a side count its contests on both sides."""

from pyspark.sql import functions as F

from contestry.catalog import evaluation


def test_sides_sum_to_all_contests(spark, sf, tables):
    decided = tables["matches"].where("is_decided").count()
    sums = evaluation._per_team(spark, sf).agg(F.sum("s"), F.sum("n")).first()
    assert tuple(sums) == (decided, 2 * decided)
