"""Sums of ids keep every digit beyond a long."""

import duckdb
import pytest

from contestry.catalog import all_queries
from contestry.sources import contests as S


@pytest.mark.parametrize("name", ["union_sources", "partitioned_sink"])
def test_ids_sum_beyond_a_long(spark, sf, tmp_path, name):
    """Order keys near the end of their range: the ids fit a long, their sums do not."""
    far = 9_200_000_000_000
    for t in S._TABLES:
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(t)
        more = f" REPLACE (CAST({key} + {far} AS BIGINT) AS {key})" if key else ""
        duckdb.sql(f"COPY (SELECT *{more} FROM '{sf}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    query = all_queries()[name]
    near, got = query(spark, sf), query(spark, str(tmp_path))
    keys = [c for c in near.columns if c not in ("rows", "ids")]
    was = {tuple(r[c] for c in keys): (r["rows"], r["ids"]) for r in near.collect()}
    now = {tuple(r[c] for c in keys): (r["rows"], int(r["ids"])) for r in got.collect()}
    assert dict(near.dtypes)["ids"] == "bigint"
    assert now == {k: (n, ids + n * far * S.ORDER_STEP) for k, (n, ids) in was.items()} and max(i for _, i in now.values()) > 1 << 63
