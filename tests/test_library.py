"""Numeric vectors and small fixtures for the library's functions and operators."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from matchforge import registry
from matchforge.functions import derived
from matchforge.functions import scalar as S
from matchforge.functions import smoothing as M
from matchforge.operators import catalog, correct, evaluate, filters, incremental, joins, labels, profiles, windows
from matchforge.sources import shred

SF = "/root/testdata/sf0.001"


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_smoothing_vectors(spark):
    got = values(spark, M.smooth_rate("additive", 0.8, 10, 0.5, 20), M.smooth_rate("additive", 0.8, 60, 0.5, 20), M.smooth_rate("cascade", 0.8, 10, 0.5, 20), M.smooth_rate("cascade", 0.8, 60, 0.5, 20))
    assert got == pytest.approx([0.6, 0.725, 0.6, 0.8])
    assert values(spark, M.bayes_rate(0.3, 0, 0.5, 0))[0] == 0.5
    with pytest.raises(ValueError):
        M.smooth_rate("other", 0.5, 1, 0.5, 1)


def test_weights_and_blends(spark):
    nan = F.lit(float("nan"))
    assert values(spark, M.capped_weight(4, 10), M.capped_weight(12, 10), M.capped_weight(nan, 10), M.capped_weight(4, 100, 10), M.capped_weight(12, 100, 10), M.capped_weight(4, 100, 0)) == [4, 10, 0, 40, 100, 100]
    assert values(spark, M.weighted_blend(0.8, 10, [(0.5, 10)]), M.weighted_blend(0.2, 10, [(0.9, 0)])) == pytest.approx([0.65, 0.2])


def test_leave_one_out_and_levels(spark):
    rate, n = M.leave_one_out(0.5, 4, 1)
    assert values(spark, rate, n) == pytest.approx([1 / 3, 3])
    assert values(spark, *M.leave_one_out(1.0, 1, 1)) == [0.5, 0]
    yes, no = F.lit(True), F.lit(False)
    assert values(spark, M.select_level([(yes, 5), (yes, 60), (yes, 100)], 50), M.select_level([(yes, 5), (no, 60), (yes, 7)], 50), M.select_level([(no, 1)], 1)) == [1, 2, None]
    assert values(spark, M.strength_from_moments(0.5, 0.05, 0.05), M.strength_from_moments(0.5, 0.05, 0.0)) == pytest.approx([20.0, 4.0])


def test_time_and_masks(spark):
    ms = lambda x: S.nearest_minute(F.lit(x))
    assert values(spark, ms(-5), ms(29_999), ms(30_000), ms(90_000)) == [0, 0, 60_000, 120_000]
    assert values(spark, S.bitmask([(F.lit(1), 0), (F.lit(None).cast("int"), 3), (F.lit(1), 19)])) == [1 + (1 << 19)]
    assert values(spark, S.ratio(F.lit(1.0), F.lit(0.0)), S.over_one(F.lit(2.0), F.lit(8.0)), S.over_one(F.lit(2.0), F.lit(0.0))) == [0.0, 0.25, 2.0]


def test_derived_metrics(spark):
    df = spark.createDataFrame([(7.0, 3.0, 2.0, 400.0, 200.0, 12000.0, 30.0, 10.0, 10.0, 50.0, 80.0)], "kills double, deaths double, assists double, largestcriticalstrike double, attackdamage double, goldearned double, physicaldamagetaken double, magicdamagetaken double, truedamagetaken double, totaldamagetaken double, totaldamagedealttochampions double")
    row = derived.add_derived(df).first().asDict()
    assert [row[k] for k in ("physicaldamagetaken_share", "magicdamagetaken_share", "truedamagetaken_share", "net_combat_damage", "net_kills", "largestcriticalstrike_to_attackdamage_ratio", "goldearned_to_deaths_ratio")] == pytest.approx([0.6, 0.2, 0.2, 30, 4, 2.0, 4000])
    assert len(derived.NAMES) == 89 and len(set(derived.NAMES)) == 89
    zero = derived.add_derived(df.select(*[F.lit(0.0).alias(c) for c in df.columns])).first()
    assert not any(zero)


def test_catalog_matches_hand_numbers(spark):
    rows = [(1, "TOP", "a", 80), (1, "TOP", "b", 20), (1, "TOP", "c", 1), (2, "TOP", "a", 900), (2, "TOP", "b", 100)]
    out = {(r.championid, r.build): r for r in catalog.build_catalog(spark.createDataFrame(rows, "championid int, teamposition string, build string, n long"), 20, 0.01).collect()}
    assert (1, "c") not in out
    assert out[1, "a"].retained_mass == pytest.approx(100 / 101)
    assert out[1, "a"].p == pytest.approx((80 + 20 * 980 / 1100) / 120)
    assert out[1, "b"].p == pytest.approx((20 + 20 * 120 / 1100) / 120)


def test_joint_worlds_equal_brute_force(spark):
    from itertools import product

    slots = [[("a", 0.6), ("b", 0.3), ("z", 0.0)], [("c", 0.5), ("d", 0.5)], [("e", 0.9), ("f", 0.1)]]
    df = spark.createDataFrame([(1, slots)], "game int, slots array<array<struct<build:string,p:double>>>")
    got = [(r.builds, r.weight) for r in catalog.joint_worlds(df, "slots", 3, 20, 0.7).orderBy("world").collect()]
    every = sorted(((-math.prod(p for _, p in c), [b for b, _ in c]) for c in product(*slots) if all(p > 0 for _, p in c)), key=lambda x: (round(x[0], 12), x[1]))
    mass, want = 0.0, []
    for w, b in every:
        if mass >= 0.7:
            break
        want.append((b, -w))
        mass -= w
    assert [b for b, _ in got] == [b for b, _ in want]
    assert [w for _, w in got] == pytest.approx([w for _, w in want])


def test_gaps_queue_and_metadata(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x] or [], "matchid string")
    everything = ids("EUW1_1", "NA1_1", "KR_1", "BR1_1")
    got = {r.matchid: r.gap for r in incremental.classify_gaps(everything, everything, ids("EUW1_1", "KR_1", "BR1_1"), ids("KR_1"), ids("EUW1_1")).collect()}
    assert got == {"EUW1_1": "metadata_only", "NA1_1": "stream_partial", "KR_1": "complete", "BR1_1": "blocked"}
    assert {r.matchid for r in incremental.seed_queue(everything, [ids("KR_1", "NA1_1"), ids("KR_1")], ids("BR1_1")).collect()} == {"EUW1_1", "NA1_1"}
    people = spark.createDataFrame([("m", i, f"p{i}") for i in range(10)] + [("n", 1, "x")], "matchid string, participantid int, puuid string")
    assert [(r.matchid, r.participants[9]) for r in incremental.rebuild_metadata(people).collect()] == [("m", "p9")]


def test_labels_keep_one_row_and_break_ties(spark):
    p = spark.createDataFrame([(1, 3, 0, None), (2, 0, 0, 0)], "k int, a int, b int, c int")
    assert sorted((r.k, r.itemid) for r in labels.explode_items(p, ["k"], ["a", "b", "c"]).collect()) == [(1, 3), (2, 0)]
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.5, 2.0)], "crit double, on_hit double")
    assert [r.label for r in labels.argmax_label(df, ["crit", "on_hit"]).collect()] == ["crit", "none", "on_hit"]


def test_correction_clamps_and_counts_once(spark):
    kills = spark.createDataFrame([("m", 95_000, "x", 1, 2, [3]), ("m", 95_000, "x", 1, 2, [3]), ("m", 10_000, "y", 1, 2, [])], "matchid string, timestamp long, id string, killerid int, victimid int, assistingparticipantids array<int>")
    ends = spark.createDataFrame([("m", 100_000)], "matchid string, end_at long")
    tail = correct.padding(kills, ends, ["matchid", "id"])
    deltas = correct.delta_totals(correct.kill_deltas(tail), ["matchid", "participantid"])
    stats = spark.createDataFrame([("m", 1, 5.0, 0.0, 1.0), ("m", 2, 1.0, 0.0, 0.0), ("m", 3, 0.0, 0.0, 2.0)], "matchid string, participantid int, kills double, deaths double, assists double")
    got = {r.participantid: (r.kills, r.deaths, r.assists) for r in correct.apply_deltas(stats, deltas, ["matchid", "participantid"]).collect()}
    assert got == {1: (4.0, 0.0, 1.0), 2: (1.0, 0.0, 0.0), 3: (0.0, 0.0, 1.0)}


def test_temporal_shrink_falls_to_the_parent(spark):
    rows = [("a", "x", 0, 1000, 1000.0), ("b", "x", 0, 1000, 3000.0), ("b", "x", 1, 10, 50.0)]
    got = {(r.k, r.bucket): (r.mean, r.observed) for r in profiles.temporal_shrink(spark.createDataFrame(rows, "k string, p string, bucket int, frames long, v double"), "k", "p", "v").collect()}
    assert 1 < got["a", 0][0] < 2 and got["a", 1] == (5.0, 0)


def test_shredding(spark):
    event = {"type": "CHAMPION_KILL", "timestamp": 8000, "killerId": 2, "victimId": 5, "assistingParticipantIds": [3, 4], "victimDamageDealt": [{"participantId": 1, "physicalDamage": 7}, {"participantId": 2}]}
    kills = {"metadata": {"matchId": "EUW1_1"}, "info": {"frames": [{"timestamp": 60000, "participantFrames": {"1": {"participantId": 1, "position": None}}, "events": [event, {"type": "CHAMPION_KILL", "timestamp": 8001, "killerId": 6, "victimId": 7}, {"type": "CHAMPION_SPECIAL_KILL", "timestamp": 9, "killType": "KILL_ACE", "position": {"x": 10, "y": 20}}, {"type": "GAME_END", "timestamp": 10, "winningTeam": 100}]}]}}
    aborted = {"metadata": {"matchId": "X"}, "info": {"endOfGameResult": "Abort_x", "frames": kills["info"]["frames"]}}
    t = shred.shred_timeline(spark.createDataFrame([(json.dumps(kills),), (json.dumps(aborted),)], "payload string"))
    assert [(r.champion_kill_event_id, r.assistingParticipantIds) for r in t["tl_champion_kill"].orderBy("timestamp").collect()] == [("EUW1_1:8000:2:5", [3, 4]), ("EUW1_1:8001:6:7", [])]
    assert [(r.idx, r.physicalDamage) for r in t["tl_ck_victim_damage_dealt"].orderBy("idx").collect()] == [(0, 7), (1, None)]
    special = t["tl_champion_special_kill"].first()
    assert (special.frame_timestamp, special.position_x, special.multiKillLength, special.type) == (60000, 10, None, "CHAMPION_SPECIAL_KILL")
    assert t["tl_game_end"].first().gameId is None and "type" not in t["tl_game_end"].columns
    assert t["tl_participant_stats"].first().position_x == 0 and len(t) == 23


def test_game_version_and_drift(spark):
    df = spark.createDataFrame([("16.3.7.1",), ("16.3",), ("a.b.c",)], "v string")
    assert [tuple(r) for r in df.select(*shred.game_version(F.col("v"))).collect()] == [(16, 3, "7.1"), (-1, -1, "unknown"), (-1, -1, "c")]
    raw = spark.createDataFrame([("m", '{"info": {"a": 1, "x": 2}}')], "matchid string, payload string")
    assert sorted((r.kind, r.names) for r in shred.schema_drift(raw, {"$.info": ["a", "b"]}).collect()) == [("missing", ["b"]), ("unexpected", ["x"])]


def test_bias_fit_and_any_join(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 1), (0.0, 1), (0.0, 0)], "logit double, y int")
    assert evaluate.fit_bias(df) == pytest.approx(math.log(3), abs=1e-6)
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (1, 4)], "k int, v int")
    assert sorted((r.k, r.v) for r in joins.any_join(left, right, ["k"], ["v"]).collect()) == [(1, 4), (2, None)]


def test_mask_grain(spark):
    flags = spark.createDataFrame([("m", 1, 1, 0), ("m", 2, 0, 0)], "matchid string, participantid int, low_kda int, team_kd int")
    flags = flags.withColumns({b: F.lit(0) for b in filters.BITS if b not in flags.columns})
    got = {r.participantid: (r.player_rule_mask, r.team_rule_mask, r.rule_mask, r.is_valid) for r in filters.filter_result(flags).collect()}
    assert got == {1: (1, 0, 1, 0), 2: (0, 0, 1, 0)}


def test_streaming_tables(spark, tmp_path):
    from matchforge.streaming import ingest

    path = f"{tmp_path}/in"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(path)
    stream = ingest.file_stream(spark, path, events.schema)
    q = ingest.write_tables(stream, {"all": lambda b: b, "clicks": lambda b: b.where("event_type = 'click'")}, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/all").count() == events.count()
    assert spark.read.parquet(f"{tmp_path}/out/clicks").count() == events.where("event_type = 'click'").count()


def test_two_streams_become_one_row_per_match(spark, tmp_path):
    import datetime

    from matchforge.streaming import ingest

    start = datetime.datetime(2024, 1, 1)
    for name, ids, minutes in (("s", range(20), 0), ("t", range(10, 30), 5)):
        rows = [(i, start + datetime.timedelta(minutes=i + minutes), f"{name}{i}") for i in ids]
        spark.createDataFrame(rows, "matchid long, ts timestamp, payload string").write.parquet(f"{tmp_path}/{name}")
    read = lambda n: ingest.file_stream(spark, f"{tmp_path}/{n}", "matchid long, ts timestamp, payload string")
    q = ingest.merge_streams(read("s"), read("t")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.matchid, r.summary, r.timeline) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(i, f"s{i}", f"t{i}") for i in range(10, 20)}


def test_nulls_and_empty_tables(spark):
    from matchforge.operators import augment, event_metrics, joins, semantic

    base = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("matchid"), "o_custkey")
    d = joins.Dictionary(spark.createDataFrame([(1, "one"), (None, "nothing")], "k long, name string"), ["k"], {"name": "?"})
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    assert sorted(((r.x or 0), r.name, r.found) for r in d.look_up(rows, {"k": "x"}).collect()) == [(0, "?", 0), (1, "one", 1), (2, "?", 0)]
    events = spark.createDataFrame([(1, 0, 100, "CHAMPION_KILL", 2, None, None)], "matchid long, frame_timestamp long, timestamp long, type string, killerId int, victimId int, assistingParticipantIds array<int>")
    names = "participantId creatorId bounty shutdownBounty killStreakLength multiKillLength".split()
    events = events.withColumns({n: F.lit(None).cast("int") for n in names} | {n: F.lit(None).cast("string") for n in "killType laneType towerType buildingType monsterType monsterSubType".split()})
    for grain in ("minute", "player", "match"):
        assert event_metrics.event_metrics(events.where("false"), grain).count() == 0
    killer = {r.participantid: r for r in event_metrics.event_metrics(events, "minute").collect()}[2]
    assert killer.championKillEventsPerMinuteBin == 1.0 and killer.kdaPerMinuteBin == 1.0 and killer.wardsPlacedPerMinuteBin == 0.0
    one = spark.createDataFrame([(0.6, 0.3, 0.1, 0.95, 0.9, 0.2, 0.7, 0.1, 0.3, 2500.0, 600.0, 100, "TOP", 1, "crit", 887)], ", ".join(f"{c} double" for c in [*semantic.SHARES, *semantic.PRESSURES, "hp", "attack_range"]) + ", teamid int, teamposition string, matchid int, build string, championid int")
    r = semantic.group_features(one).first()
    assert (r.burst, r.hard_cc, r.high_hp, r.ranged, r.skirmish, r.same_role_range, r.range_pressure) == (0.0, 1.0, 1.0, 1.0, 1.0, 0.0, pytest.approx(0.875))
    assert r.mixed_damage == pytest.approx(0.6) and r.frontline_intensity == pytest.approx(max((0.9 - 0.702) / 0.24, (2500 - 2253.5) / 450))
    assert semantic.group_features(one.where("false")).count() == 0 and augment.side_swap(base.where("false").withColumn("label", F.lit(1)), [], [], "label").count() == 0
    with pytest.raises(ValueError):
        filters.participant_flags(spark.createDataFrame([], "matchid long, participantid int, teamid int, win int, kills long, deaths long, assists long, damage long, goldearned long, goldspent long, totalminionskilled long, neutralminionskilled long, timeplayed long, teamposition string, spellcasts int, itemspurchased int"))
    with pytest.raises(Exception, match="outside 0 to 1"):
        spark.range(1).select(M.bayes_rate(0.5, 3, 1.5, 2)).collect()


ORACLES = ["der_all_identity_metrics", "frm_all_frame_metrics", "tot_all_total_metrics", "qty_all_team_shares", "qty_all_role_opponents", "met_minute_event_metrics", "met_player_event_metrics", "met_match_event_metrics", "sem_all_group_features", "shr10_participant_frames", "shr11_3_elite_monster_kill", "shr13_victim_damage_dealt", "shr9_perk_ids", "smo_scalar_family", "smo18_hierarchical", "dic6_matchup_1v1", "scf_scalars", "cor5_signed_deltas", "cat5_marginal_score", "joi17_interval_as_of", "win5_chrono_split", "smo20_solo_prior_features", "cmb1_matchup_1v1", "rul_d_filter_result", "cat1_build_catalog", "win7_resolve_rules", "shr2_info"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df, sql = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    want = sorted(map(repr, [tuple(r) for r in sql.project(", ".join(f'"{c}"' for c in order)).fetchall()]))
    assert sorted(map(repr, [tuple(r) for r in df.select(*order).collect()])) == want
