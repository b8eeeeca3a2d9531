"""Plans of registered queries: what has to be done once is done once, and what grows with the input is spread over tasks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["shr1_metadata", "shr3_bans", "shr6_behaviour_lifted", "shr9_perk_ids", "shr10_participant_frames"])
def test_a_payload_is_parsed_once(spark, name):
    assert plan(entry.queries()[name](spark, SMALL)).count("from_json(") == 1


@pytest.mark.parametrize("name", ["rep6_season_counts", "lab3_archetype_label", "smo25_side_swap", "pro3_team_shares", "pro5_context_combine"])
def test_tasks_grow_in_number_with_lines_not_in_size(spark, name, monkeypatch):
    from matchforge.plans import adapters

    run = entry.queries()[name]
    few = sorted(map(repr, run(spark, SMALL).collect()))
    monkeypatch.setattr(adapters, "LINES_OF_A_TASK", 1000, raising=False)
    many = run(spark, SMALL)
    assert "hashpartitioning(l_orderkey" in plan(many) and "REPARTITION_BY_NUM" in plan(many)
    assert sorted(map(repr, many.collect())) == few


def test_seats_of_a_match_are_counted_without_copies_of_rows(spark):
    from matchforge.operators import reports

    rows = [(1, 1, 100, "TOP", 1), (1, 1, 100, "TOP", 2), (1, 1, 200, None, 2), (1, 1, 200, "TOP", None), (2, 2, None, None, 1)]
    rows += [(1, 3, t, r, i) for i, (t, r) in enumerate((t, r) for t in (100, 200) for r in "abcde")]
    df = spark.createDataFrame(rows, "season int, matchid int, teamid int, teamposition string, participantid int")
    out = reports.season_counts(df)
    assert {tuple(r) for r in out.collect()} == {(1, 12, 1), (2, 1, 1)}
    assert "Expand" not in plan(out)


def test_rows_of_a_metric_do_not_meet_in_a_task(spark):
    from matchforge.operators import profiles

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(float(i), None if i % 3 else float(i * i)) for i in range(100)], "a double, b double")
        out = profiles.median_mad(df, ["a", "b"])
        assert {r.metric: (r.median, r.mad) for r in out.collect()} == {"a": (49.5, 25.0), "b": (2452.5, 2178.0)}
        large = profiles.median_mad(spark.range(10).selectExpr("cast(id as double) AS a"), ["a"])
        assert plan(large).count("BroadcastHashJoin") >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_bundle_reads_its_rows_once(spark):
    from matchforge.operators import bundle

    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (read.add(1), x)[1], "int").asNondeterministic()
    players = [(m, 100 if s < 2 else 200, s, (m * 5 + s) % 3, ("TOP", None)[s % 2], "xy"[m % 2], int((s < 2) == (m % 3 > 0))) for m in range(30) for s in range(4)]
    rows = spark.createDataFrame(players, "matchid int, teamid int, participantid int, championid int, teamposition string, build string, win int")
    want = bundle.prior_features(rows, rows.where("matchid < 20"), ["build", "nobuild"], ["build", "champion"])
    got = bundle.prior_features(rows.withColumn("championid", seen("championid")), F.col("matchid") < 20, ["build", "nobuild"], ["build", "champion"])
    key = lambda df: sorted((r.matchid, r.kind, r.slot, -1 if r.other is None else r.other, round(r.value, 12), r.n) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 30 * (4 + 4 + 2)
    assert read.value == len(players)


def test_drift_parses_a_payload_once_for_all_checks(spark):
    found = entry.queries()["shr15_drift_findings"](spark, SMALL)
    assert plan(found).count("parseJson(") == 1 and plan(found).count("FileScan") == 1


def test_payloads_are_dealt_to_more_tasks_as_tables_grow_and_made_row_by_row(spark, monkeypatch):
    from matchforge.plans import shred_queries

    run = entry.queries()["shr_staged_tables"]
    few = {r.name: r.n for r in run(spark, SMALL).collect()}
    monkeypatch.setattr(shred_queries, "EVENTS_OF_A_TASK", 100, raising=False)
    monkeypatch.setattr(shred_queries, "PEOPLE_OF_A_TASK", 1000, raising=False)
    texts = shred_queries.timelines(spark, SMALL)
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    shown = plan(texts)
    assert shown.count("Exchange") == 1 and "REPARTITION_BY_NUM" in shown  # before events have their fields
    assert texts.rdd.getNumPartitions() == -(-events // 100)
    people = plan(shred_queries.summaries(spark, SMALL))
    assert "REPARTITION_BY_NUM" in people and "lambdafunction(struct(participantId" not in people
    assert {r.name: r.n for r in run(spark, SMALL).collect()} == few and len(few) == 31
