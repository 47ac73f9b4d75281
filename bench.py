"""Time the headline queries: one JSON line on stdout."""

import json
import os
import sys
import time

from contestry.catalog import all_queries
from contestry.session import get_spark
from contestry.sources import contests

HEADLINE = (
    "contest_view", "team_table", "head_to_head", "toss_by_venue", "venue_profiles", "scoring_by_season",
    "squad_continuity", "officials_table", "pair_features", "elo_ratings", "forecast_metrics", "reliability_table",
    "feature_drift", "quarantine_reasons",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    queries, times = all_queries(), {}

    def timed(name, run):
        t = time.time()
        run()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr)

    timed("canonical_tables", lambda: contests.stored(spark, sf))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
