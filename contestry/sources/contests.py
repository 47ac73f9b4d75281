"""Contests derived from the order tables: the suppliers of an order meet two by two, in line order, at
the customer's nation on the order date, and the larger quantity wins. Only the last supplier of an odd
number has no opponent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.operators import cleaning as C
from contestry.session import Stage

ERA_FROM = 1999
PLAYOFFS = 4
FIRST_VALID, DEV_LAST, HOLDOUT = 1996, 1999, (2000, 2001)
SEED = 42
#: Contest ids are order key times this plus the number of the pair; odd, so that remainders mix both.
ORDER_STEP = 1_000_003
SQUAD_COLUMNS = ("team1_squad", "team2_squad")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_contests(spark: SparkSession, sf_dir: str, squads: bool = False) -> DataFrame:
    """One row per contest, with the recorded facts only; with ``squads`` also the sorted distinct parts of either side.

    Line items are summed per (order, supplier, part) before anything is shuffled by order, so a part
    that owns a large share of an order's rows arrives already reduced. That one shuffle by order then serves
    the sums per supplier, the line order, the pairs and the join with the orders, and the squads come along,
    so that the line items are read once. An order with more pairs than ids leave room for raises.
    """
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"),
        F.min("l_linenumber").alias("line"), F.max("l_extendedprice").alias("price"),
    )
    listed = [F.expr("transform(sort_array(collect_list(struct(l_partkey))), x -> x.l_partkey) AS squad")] if squads else []
    sides = parts.repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
        F.expr("CAST(sum(quantity) AS bigint) AS runs"),
        F.expr("CAST(sum(n) % 10 AS bigint) AS wickets"),
        F.expr("min(line) AS first_line"),
        F.expr("max(struct(price, -l_partkey AS neg)) AS best"),
        *listed,
    )
    order = Window.partitionBy("l_orderkey").orderBy("first_line", "l_suppkey")
    side = F.struct("l_suppkey", "runs", "wickets", "best", *(["squad"] if squads else []))
    ranked = sides.select("l_orderkey", (F.row_number().over(order) - 1).alias("at"), side.alias("a"), F.lead(side).over(order).alias("b"))
    pairs = ranked.where("at % 2 = 0 AND b.l_suppkey IS NOT NULL").selectExpr(
        "l_orderkey", "at DIV 2 AS pair_no", "-greatest(a.best, b.best).neg AS best_part",
        *[
            f"{x}.{c} AS {name}"
            for i, x in ((1, "a"), (2, "b"))
            for c, name in (
                ("l_suppkey", f"team{i}"), ("runs", f"team{i}_runs"), ("wickets", f"team{i}_wickets"),
                *([("squad", f"team{i}_squad")] if squads else []),
            )
        ],
    )

    sup = table(spark, sf_dir, "supplier")
    places = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    ).select("c_custkey", "c_nationkey", "n_name", "n_regionkey")
    m = (
        table(spark, sf_dir, "orders")
        .join(places, F.expr("o_custkey = c_custkey"))
        .join(pairs, F.expr("o_orderkey = l_orderkey"))
        .join(sup.selectExpr("s_suppkey AS team1", "s_nationkey AS n1"), "team1")
        .join(sup.selectExpr("s_suppkey AS team2", "s_nationkey AS n2"), "team2")
    )
    no_result = "(o_orderstatus = 'P' AND o_orderkey % 25 = 0)"
    crowded = "CAST(raise_error(concat('too many suppliers in order ', o_orderkey)) AS bigint)"
    m = m.selectExpr(
        f"CASE WHEN pair_no < {ORDER_STEP} THEN o_orderkey * {ORDER_STEP} + pair_no ELSE {crowded} END AS match_id",
        "to_date(o_orderdate) AS date",
        "date_format(o_orderdate, 'dd-MM-yyyy') AS date_raw",
        "unix_date(to_date(o_orderdate)) AS day",
        "CAST(year(o_orderdate) AS bigint) AS season_year",
        "CAST(n_regionkey AS bigint) AS league",
        "CAST(c_nationkey AS bigint) AS venue_id",
        "n_name AS venue",
        "team1", "team2", "team1_runs", "team2_runs", "team1_wickets", "team2_wickets",
        "CASE WHEN o_orderkey % 2 = 0 THEN team1 ELSE team2 END AS toss_winner",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'bat' ELSE 'field' END AS toss_decision",
        f"CASE WHEN {no_result} THEN 'no result' WHEN team1_runs = team2_runs THEN 'tie' ELSE 'complete' END AS result_type",
        "n1 = c_nationkey AS team1_home",
        "n2 = c_nationkey AS team2_home",
        f"CASE WHEN NOT {no_result} THEN best_part END AS player_of_match",
        "o_custkey AS umpire1",
        "o_orderkey % 40 AS umpire2",
        f"CASE WHEN NOT {no_result} AND team1_runs > team2_runs THEN team1"
        f" WHEN NOT {no_result} AND team1_runs < team2_runs THEN team2 END AS winner",
        *(SQUAD_COLUMNS if squads else ()),
    )
    m = C.with_batting_order(m)
    # Every 41st result carries the other kind of margin, as a revised target would.
    by_runs = "((winner = bat_first) <> (match_id % 41 = 0))"
    wickets = "10 - CASE WHEN winner = team1 THEN team1_wickets ELSE team2_wickets END"
    return m.withColumns(
        {
            "win_by_runs": F.expr(f"CASE WHEN winner IS NOT NULL AND {by_runs} THEN abs(team1_runs - team2_runs) ELSE 0L END"),
            "win_by_wickets": F.expr(f"CASE WHEN winner IS NOT NULL AND NOT {by_runs} THEN {wickets} ELSE 0L END"),
        }
    )


def facts(m: DataFrame) -> dict[str, DataFrame]:
    """External fact tables in the shape of the verified lists, keyed by date and pair."""
    key = ["date_raw", "team1 AS team_a", "team2 AS team_b"]
    return {
        "super_overs": m.where("result_type = 'tie'").selectExpr(
            *key, f"{SUPER_OVER_WINNER} AS super_over_winner", f"{TIED_SCORE} AS regulation_score_tied"
        ),
        "dls": m.where("match_id % 97 = 0").selectExpr(*key),
        "voided": m.where("result_type = 'no result' AND match_id % 50 = 0").selectExpr(*key),
    }


SUPER_OVER_WINNER = "CASE WHEN match_id % 2 = 0 THEN team1 ELSE team2 END"
TIED_SCORE = "CAST(team1_runs - match_id % 3 AS double)"


def with_match_number(m: DataFrame) -> DataFrame:
    """League number of a contest; NULL marks the last four of a league's season.

    The rank is cut at four right away, so each task forwards at most four rows per season, and the
    four rows of every season go to the contests, not the contests to them.
    """
    last = Window.partitionBy("league", "season_year").orderBy(F.desc("date"), F.desc("match_id"))
    tops = (
        m.select("league", "season_year", "date", "match_id")
        .withColumn("pos", F.row_number().over(last))
        .where(f"pos <= {PLAYOFFS}")
        .select("match_id", F.lit(True).alias("top"))
    )
    return m.join(F.broadcast(tops), "match_id", "left").withColumn(
        "match_number", F.when(F.col("top").isNull(), F.col("match_id"))
    ).drop("top")


def matches(spark: SparkSession, sf_dir: str, stages: bool = True) -> DataFrame:
    """The canonical contest table. ``stages=False`` skips the playoff ranking where unused."""
    m = with_outcomes(base_contests(spark, sf_dir))
    if stages:
        m = C.with_stage(with_match_number(m), SEASON, special=None)
        m = C.with_champion(m, SEASON)
    return m


def with_outcomes(base: DataFrame) -> DataFrame:
    """Everything that follows from the recorded facts of a contest alone."""
    m = C.with_innings(C.with_result(base))
    tied = "CASE WHEN result_type = 'tie' THEN {} ELSE {} END"
    m = m.withColumns(
        {c: F.expr(tied.format(TIED_SCORE, c)) for c in ("first_innings_runs", "second_innings_runs")}
        | {
            **{c: F.expr(tied.format("NULL", c)) for c in ("first_innings_wickets", "second_innings_wickets")},
            "super_over_winner": F.expr(tied.format(SUPER_OVER_WINNER, "NULL")),
            "voided": F.expr("result_type = 'no result' AND match_id % 50 = 0"),
            "dls_heuristic": C.dls_heuristic(),
            "dls_external": F.expr("match_id % 97 = 0"),
            "impact_era": F.expr(f"season_year >= {ERA_FROM}"),
        }
    )
    return m.withColumns({"scores_usable": C.scores_usable(), "dls_flag": F.expr("dls_heuristic OR dls_external")})


SEASON = ["league", "season_year"]


#: By application, folder and the state of the folder's files.
_STORED: dict[tuple, dict[str, DataFrame]] = {}
_TABLES = ("lineitem", "orders", "customer", "nation", "supplier")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """A checksum over path, length and time of the files that contests derive from; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in _TABLES])
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.select("path", "length", "modificationTime").agg(F.count(F.lit(1)), F.sum(mark)).first())


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Canonical tables written once per application and state of the files, and read back: ``matches``, ``players``
    and ``listed``, the contests with both squads.

    Written are the recorded facts with the squads, the labels of the last four contests of a season and the
    champions. What follows from a row alone is derived where it is read, so only what a pass uses is scanned or
    computed, and nothing of the size of the contests is shuffled again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _STORED:
        stage = Stage(spark, "canonical")
        base = stage.write(base_contests(spark, sf_dir, squads=True), "contests")
        m = with_outcomes(base)
        ranked = C.with_stage(with_match_number(m.select("match_id", *SEASON, "date", "winner")), SEASON, special=None)
        last = stage.write(ranked.where("is_playoff").select("match_id", "stage", *SEASON, "winner"), "last")
        m = m.join(F.broadcast(last.select("match_id", "stage")), "match_id", "left").withColumn("match_number", F.expr("CASE WHEN stage IS NULL THEN match_id END"))
        m = C.with_stage_flags(m)
        champs = last.where("stage = 'final'").groupBy(*SEASON).agg(F.max("winner").alias("season_champion"))
        listed = m.join(F.broadcast(stage.write(champs, "champions")), SEASON, "left")
        _STORED[key] = {"matches": listed.drop(*SQUAD_COLUMNS), "players": squads_of(base), "listed": listed}
    return _STORED[key]


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table without ratings, written once per application."""
    from contestry.operators.asof import pair_features

    tables = stored(spark, sf_dir)
    if "features" not in tables:
        f = pair_features(tables["listed"], tables["players"])
        tables["features"] = Stage(spark, "features").write(f, "features")
    return tables["features"]


def stored_ratings(spark: SparkSession, sf_dir: str):
    """(ratings, games) under the default parameters, solved once per application."""
    from contestry.operators.elo import solve

    tables = stored(spark, sf_dir)
    if "ratings" not in tables:
        tables["ratings"], tables["games"] = solve(tables["matches"])
    return tables["ratings"], tables["games"]


def stored_rated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of decided contests, ratings included."""
    from contestry.operators.asof import pair_features

    tables = stored(spark, sf_dir)
    if "rated_features" not in tables:
        ratings, _ = stored_ratings(spark, sf_dir)
        f = pair_features(tables["listed"], tables["players"], ratings).where("is_decided")
        tables["rated_features"] = Stage(spark, "features").write(f, "rated")
    return tables["rated_features"]


def sides_of(m: DataFrame) -> DataFrame:
    """(match_id, l_orderkey, l_suppkey): the line item key of either side."""
    return m.select("match_id", F.expr(f"match_id DIV {ORDER_STEP} AS l_orderkey"), F.explode(F.array("team1", "team2")).alias("l_suppkey"))


def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: line items given, line items of suppliers with an opponent, and contests."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    used = li.join(sides_of(base_contests(spark, sf_dir)), ["l_orderkey", "l_suppkey"], "left")
    return used.agg(
        F.sum("n").alias("lines_given"), F.expr("sum(CASE WHEN match_id IS NOT NULL THEN n ELSE 0 END)").alias("lines_used"),
        F.expr("count(match_id) DIV 2").alias("contests"),
    )


def squads_of(m: DataFrame) -> DataFrame:
    """(match_id, team, player, slot_no) of contests that carry their squads."""
    sides = F.array(*[F.struct(F.col(f"team{i}").alias("team"), F.col(c).alias("squad")) for i, c in enumerate(SQUAD_COLUMNS, 1)])
    return (
        m.select("match_id", F.explode(sides).alias("s"))
        .select("match_id", "s.team", F.posexplode("s.squad").alias("slot", "player"))
        .select("match_id", "team", "player", (F.col("slot") + 1).cast("long").alias("slot_no"))
    )


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, team, player, slot_no): the distinct parts each side brings to a contest."""
    return squads_of(base_contests(spark, sf_dir, squads=True))
