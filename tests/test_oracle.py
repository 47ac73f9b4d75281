"""A cross-section of the registered queries against DuckDB; tools/check_oracle.py runs all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import connect, rows_of

NAMES = (
    "canonical_matches", "team_table", "toss_by_venue", "venue_profiles", "era_scoring_test", "squad_continuity", "asof_form",
    "asof_head_to_head", "asof_venue", "asof_squad", "pair_features", "fixture_features_as_of", "reliability_table", "feature_drift",
    "quarantine_reasons", "append_counts", "scenario_tornado", "exact_price_quantiles",
)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(cols, cur.fetchall()) and got


def test_entry_and_registry(spark):
    assert entry(spark).count() == 10
    assert set(oracle_sql()) <= set(queries())
