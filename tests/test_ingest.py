import pytest
from pyspark.sql import functions as F

from contestry.operators import append as AP
from contestry.operators import store as ST
from contestry.operators import validate as V
from contestry.operators import versions as VN
from contestry.plans import canonical as P
from contestry.sources import files as FI
from contestry.streaming.append import append_stream

SQUAD_A = ", ".join(f"A{i}" for i in range(11))
SQUAD_B = ", ".join(f"B{i}" for i in range(11))
GOOD = {
    **V.CONSTANTS, "season": "2020", "match_number": "1", "date": "01-04-2020", "city": "Town", "venue": "Ground",
    "team1": "Reds", "team2": "Blues", "toss_winner": "Reds", "toss_decision": "bat", "team1_runs": "180",
    "team1_wickets": "5", "team2_runs": "150", "team2_wickets": "9", "winner": "Reds", "result_type": "complete",
    "win_by_runs": "30", "win_by_wickets": "0", "player_of_match": "A1", "match_referee": "N/A", "umpire1": "U1",
    "umpire2": "U2", "tv_umpire": "", "reserve_umpire": "None", "team1_players": SQUAD_A, "team2_players": SQUAD_B,
}
FAULTS = [
    ({"toss_decision": "bowl"}, "schema:toss_decision:isin(['bat', 'field'])"),
    ({"toss_winner": "Somebody Else"}, "rule:toss_winner_in_match"),
    ({"team1_wickets": "11"}, "rule:wickets_le_10_unless_tie"),
    ({"date": "31-02-2020"}, "rule:valid_date"),
    ({"team2": "Reds", "winner": "Reds"}, "rule:distinct_teams"),
    ({"winner": "None"}, "rule:winner_iff_complete"),
    ({"team1_players": "A1, A2"}, "rule:squad_size"),
    ({"overs_limit": "50"}, "schema:overs_limit:isin([20])"),
    ({"team1_runs": "x", "toss_winner": "Nobody"}, "schema:team1_runs:coerce_dtype('int64')"),
    ({"win_by_wickets": "3"}, "rule:single_margin"),
]


def frame(spark, rows):
    return spark.createDataFrame([tuple({**GOOD, **r}[c] for c in V.RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in V.RAW_COLUMNS))


def test_fault_injection(spark):
    raw = frame(spark, [{"city": f"c{i}", **f} for i, (f, _) in enumerate(FAULTS)] + [{}])
    valid, bad = V.validate(raw)
    assert valid.count() == 1 and dict(valid.dtypes)["team1_runs"] == "int"
    got = {r.city: r.reason for r in bad.collect()}
    assert got == {f"c{i}": want for i, (_, want) in enumerate(FAULTS)}


def test_tie_may_have_more_wickets(spark):
    tie = {"result_type": "tie", "winner": "None", "win_by_runs": "0", "team1_wickets": "12", "team2_runs": "180"}
    assert V.validate(frame(spark, [tie]))[1].count() == 0


def test_strict_and_columns(spark):
    with pytest.raises(ValueError, match="toss_winner_in_match"):
        V.validate(frame(spark, [FAULTS[1][0]]), mode="strict")
    for bad in (frame(spark, [{}]).drop("city"), frame(spark, [{}]).withColumn("more", F.lit(1))):
        with pytest.raises(ValueError, match="column mismatch"):
            V.validate(bad)


def test_files(spark, tmp_path):
    path = str(tmp_path / "raw")
    frame(spark, [{}, {"date": "02-04-2020"}]).coalesce(1).write.option("header", True).csv(path)
    raw = FI.read_raw(spark, path)
    assert raw.count() == 2 and set(t for _, t in raw.dtypes) == {"string"}
    h = FI.fingerprint(spark, path)
    FI.check_fingerprint(spark, path, h)
    with pytest.raises(ValueError):
        FI.check_fingerprint(spark, path, "0")
    with pytest.raises(ValueError):
        FI.guard_files(spark, path, ".csv", 10)
    with pytest.raises(ValueError):
        FI.guard_files(spark, path, ".tsv")
    with pytest.raises(FileNotFoundError):
        FI.guard_files(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "x", 1), ("ok", "-y", 2)], "a string, `+b` string, k int")
    FI.write_safe_csv(df, str(tmp_path / "safe"))
    back = spark.read.option("header", True).csv(str(tmp_path / "safe"))
    assert back.columns == ["a", "'+b", "k"] and {r[0] for r in back.collect()} == {"'=1+1", "ok"}
    FI.write_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 2").count() == 1
    calls = []
    build = lambda: calls.append(1) or df.select("a", "k")
    for _ in range(2):
        assert FI.read_or_build(spark, str(tmp_path / "cache"), build).count() == 2
    assert len(calls) == 1
    FI.write_report({"s": df.select("k", "a")}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/s")).count() == 2


def knowledge(spark):
    return P.Knowledge(
        teams=spark.createDataFrame([("R", "Reds"), ("B", "Blues")], "team_id string, name string"),
        team_alias=spark.createDataFrame([("Reds", "R", 2008, 2100), ("Blues", "B", 2008, 2100)], "alias string, team_id string, valid_from int, valid_to int"),
        venues=spark.createDataFrame([("g", "The Ground", "Town", "Land")], "venue_id string, name string, city string, country string"),
        venue_alias=spark.createDataFrame([("Ground", "g")], "alias string, venue_id string"),
        spells=spark.createDataFrame([("R", "g", 1, 1, 2008, 2100)], "team string, venue_id string, spell_no int, ordinal int, valid_from int, valid_to int"),
        neutral=spark.createDataFrame([(2009,)], "season_year int"),
    )


def no_facts(spark):
    key = "date_raw string, team_a string, team_b string"
    return P.Facts(spark.createDataFrame([], key + ", super_over_winner string, regulation_score_tied double"), spark.createDataFrame([], key), spark.createDataFrame([], key))


def test_canonical_build(spark):
    rows = [{"date": f"0{i}-04-2020", "match_number": str(i)} for i in range(1, 4)]
    rows += [{"date": f"1{i}-05-2020", "match_number": "N/A"} for i in range(3)] + [FAULTS[0][0]]
    c = P.build(frame(spark, rows), knowledge(spark), no_facts(spark))
    m = {r.match_id: r for r in c.matches.collect()}
    assert sorted(m) == [1, 2, 3, 4, 5, 6] and [m[i].stage for i in (4, 5, 6)] == ["semi_final", "semi_final", "final"]
    assert m[1].season_champion == "R" and m[1].team1_home and not m[1].team2_home and m[1].venue == "The Ground"
    assert c.players.count() == 6 * 22 and c.rejected.count() == 1
    assert {r.fix: r.rows for r in c.fixes.collect()}["stage_derived_playoff"] == 3
    assert set(P.quality_report(c)) >= {"nulls", "seasons", "fixes"}


@pytest.mark.parametrize("row, text", [({"team1": "Greens", "toss_winner": "Greens", "winner": "Greens"}, "Greens"), ({"venue": "Elsewhere"}, "Elsewhere"), ({"result_type": "tie", "winner": "None", "win_by_runs": "0", "team2_runs": "180"}, "no verified result")])
def test_unmapped_fails_loudly(spark, row, text):
    with pytest.raises(Exception, match=text):
        P.build(frame(spark, [row]), knowledge(spark), no_facts(spark)).matches.collect()


def test_knowledge_cross_check(spark):
    k = knowledge(spark)
    k.team_alias = k.team_alias.unionByName(spark.createDataFrame([("X", "nobody", 1, 2)], k.team_alias.schema))
    with pytest.raises(ValueError, match="nobody"):
        k.check()


def test_append_flow(spark, tmp_path):
    base = str(tmp_path / "store")
    AP.publish(spark, frame(spark, [{}]), base)
    run = lambda rows, **kw: AP.process_append(spark, base, frame(spark, rows), **kw)
    again = run([{}, {"team1": "Blues", "team2": "Reds"}], dry_run=False)
    assert (again.rows_new, again.rows_duplicate, again.applied) == (0, 2, False)
    with pytest.raises(ValueError):
        run([FAULTS[0][0]], dry_run=False)
    new = {"date": "09-04-2020"}
    clean = lambda v: P.clean(v, knowledge(spark), no_facts(spark), 2023)
    assert run([new, new], clean=clean).rows_new == 1 and AP.current_version(spark, base)[0] == 1
    with pytest.raises(Exception, match="Greens"):
        run([{**new, "team1": "Greens", "toss_winner": "Greens", "winner": "Greens"}], dry_run=False, clean=clean)
    assert AP.current_version(spark, base)[0] == 1
    done = run([new, new], dry_run=False, clean=clean)
    assert done.applied and done.rows_duplicate == 1 and AP.read_current(spark, base).count() == 2


def test_two_writers_lose_no_rows(spark, tmp_path):
    """A second writer that publishes between the first one's dedupe and commit: both sets are stored, once."""
    base = str(tmp_path / "store")
    AP.publish(spark, frame(spark, [{}]), base)
    seen = VN.snapshot(spark, base)
    days = lambda *d: frame(spark, [{"date": f"{i:02d}-04-2020"} for i in d])
    other = lambda attempt: attempt == 0 and AP.process_append(spark, base, days(2, 3), dry_run=False)
    done = AP.process_append(spark, base, days(3, 4), dry_run=False, before_commit=other)
    assert (done.rows_new, done.rows_duplicate, done.version) == (1, 1, 3)
    assert sorted(r.date[:2] for r in AP.read_current(spark, base).collect()) == ["01", "02", "03", "04"]
    with pytest.raises(VN.Conflict):
        AP.publish(spark, days(9), base, seen)
    assert AP.current_version(spark, base)[0] == 3 and len(list((tmp_path / "store/rows").iterdir())) == 3


def test_compaction_keeps_rows_and_appends(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    for d in (1, 2, 3):
        AP.publish(spark, frame(spark, [{"date": f"0{d}-04-202{d}", "season": f"202{d}/2{d + 1}"}]), base)
    write, late = VN.write_rows, frame(spark, [{"date": "09-04-2020"}])

    def meanwhile(df, *args):
        folder = write(df, *args)
        if late is not None and len(VN.snapshot(spark, base).folders) == 3:
            monkeypatch.setattr(VN, "write_rows", write)
            AP.publish(spark, late, base)
        return folder

    monkeypatch.setattr(VN, "write_rows", meanwhile)
    at = VN.compact(spark, base)
    assert (at.version, len(at.folders)) == (5, 2)
    rows = AP.read_current(spark, base)
    assert sorted(r.date for r in rows.collect()) == ["01-04-2021", "02-04-2022", "03-04-2023", "09-04-2020"]
    assert {r.season for r in rows.collect()} == {"2021/22", "2022/23", "2023/24", "2020"} and rows.columns == list(V.RAW_COLUMNS)
    assert AP.read_current(spark, base, VN.snapshot(spark, base, 2)).count() == 2
    assert VN.vacuum(spark, base) == 0 and VN.vacuum(spark, base, keep=1) == 3 and AP.read_current(spark, base).count() == 4
    assert [r.action for r in VN.history(spark, base).collect()] == ["compact"]


def test_dedupe_reads_only_the_years_of_the_upload(spark, tmp_path):
    base = str(tmp_path / "store")
    AP.publish(spark, frame(spark, [{"date": "01-04-2020"}, {"date": "01-04-2021", "season": "2021"}]), base)
    up = frame(spark, [{"date": "01-04-2021"}])  # same contest under another season's label
    rows = AP._stored(spark, base, VN.snapshot(spark, base), up, AP.YEAR, ["2021"])
    files = {f.split("_year=")[1][:4] for f in rows.inputFiles()}
    assert rows.count() == 1 and AP.process_append(spark, base, up).rows_new == 0
    assert "PartitionFilters" in rows._jdf.queryExecution().toString() and files >= {"2021"}


def test_first_row_of_a_repeated_key(spark):
    up = spark.createDataFrame([("d", "a", "b", "late", 2), ("d", "b", "a", "first", 1)], "date string, team1 string, team2 string, v string, at int")
    assert [r.v for r in AP.new_rows(up.limit(0), up, order="at").collect()] == ["first"]


def test_append_stream(spark, tmp_path):
    base, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    for part, rows in (("a", [{}, {"date": "02-04-2020"}]), ("b", [{}, {"date": "03-04-2020"}, FAULTS[0][0]])):
        frame(spark, rows).coalesce(1).write.option("header", True).mode("append").csv(str(inbox))
        q = append_stream(spark, str(inbox), base, str(tmp_path / "cp"), quarantine=str(tmp_path / "bad"))
        q.awaitTermination(120)
    assert AP.read_current(spark, base).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "bad")).count() == 1


def test_store(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    up = ST.upsert(d, spark.createDataFrame([(2, "B"), (3, "c")], d.schema), ["id"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    ids = ST.ensure_names(d, spark.createDataFrame([("z",), ("a",), ("m",)], "name string"))
    assert {r.name: r.id for r in ids.collect()} == {"a": 1, "b": 2, "m": 3, "z": 4}
    with pytest.raises(Exception, match="has no id"):
        ST.resolve(spark.createDataFrame([("q",)], "team string"), {"team": (d, "name", "id")}).collect()
    p = spark.createDataFrame([("r", "post_toss", "x", "y", "g", "league", "x", "bat", 0.6)], "run_id string, tier string, team_a string, team_b string, venue_id string, stage string, toss_winner string, toss_decision string, p_a double")
    ST.log_predictions(p, str(tmp_path / "log"))
    ST.log_predictions(p.withColumn("tier", F.lit("pre_toss")), str(tmp_path / "log"))
    rows = ST.latest_predictions(spark, str(tmp_path / "log"), 1).collect()
    assert len(rows) == 1 and rows[0].tier == "pre_toss" and rows[0].toss_json is None
    with pytest.raises(Exception, match="outside"):
        ST.log_predictions(p.withColumn("p_a", F.lit(1.5)), str(tmp_path / "log2"))
