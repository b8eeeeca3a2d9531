"""Payloads parsed once, and drift of payloads, on small payloads with everything wrong that can be."""

import json

from matchforge.sources import drift, shred


def frame(spark, payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "matchid int, payload string")


def held(df):
    return sorted(map(repr, df.collect()))


def people(n=5, **more):
    return [{"participantId": i, "puuid": f"p{i}", "teamId": 100, "win": i % 2 == 0, "kills": i, "challenges": {"a": "1.5", "SWARM_x": "2", "b": "no"}, **more} for i in range(n)]


MATCHES = [
    {"metadata": {"matchId": "a", "participants": ["p0"]}, "info": {"gameMode": "CLASSIC", "gameVersion": "16.2.1", "teams": [{"teamId": 100, "bans": [{"championId": 1, "pickTurn": 2}], "feats": {"x": None, "y": {"featState": 3}}}], "participants": people()}},
    {"metadata": {"matchId": "b"}, "info": {"gameMode": "CLASSIC", "participants": people(6)}},  # no teams
    {"metadata": {"matchId": "c"}, "info": {"gameMode": "CLASSIC", "participants": people(2)}},
    {"metadata": {"matchId": "d"}, "info": {"endOfGameResult": "Abort_x", "participants": people()}},
    {"metadata": {"matchId": "e"}, "info": {"gameMode": "STRAWBERRY", "participants": people()}},
    None,
    "not json",
]
TIMELINES = [
    {"metadata": {"matchId": "a"}, "info": {"frames": [{"timestamp": 60_010, "participantFrames": {"1": {"participantId": 1, "xp": 5}}, "events": [{"type": "WARD_KILL", "timestamp": 5, "killerId": 1}, {"type": "CHAMPION_KILL", "timestamp": 7, "killerId": 2, "victimId": 3, "victimDamageDealt": [{"name": "h"}]}, {"type": "NEVER/SEEN", "timestamp": 9}, {"timestamp": 1}]}]}},
    {"metadata": {"matchId": "b"}, "info": {"frames": [{"timestamp": 0, "events": [{"type": "WARD_PLACED", "timestamp": 3}]}, {"timestamp": 0, "participantFrames": {"2": {"participantId": 2}}}]}},
    {"metadata": {"matchId": "c"}, "info": {"endOfGameResult": "Abort", "frames": [{"timestamp": 0, "events": [{"type": "WARD_KILL"}]}]}},
    {"metadata": {"matchId": "d"}, "info": {}},
    None,
]


def test_staged_tables_equal_those_of_a_parse_each(spark, tmp_path):
    raw = frame(spark, MATCHES)
    shred.stage_matches(raw, f"{tmp_path}/m")
    staged, direct = shred.staged_match_tables(spark, f"{tmp_path}/m"), shred.shred_match(raw)
    assert staged.keys() == direct.keys() and all(held(staged[n]) == held(direct[n]) for n in direct)
    assert {r.matchid for r in staged["metadata"].collect()} == {"a", "b"}
    raw = frame(spark, TIMELINES)
    shred.stage_timelines(raw, f"{tmp_path}/t")
    staged, direct = shred.staged_timeline_tables(spark, f"{tmp_path}/t"), shred.shred_timeline(raw)
    assert staged.keys() == direct.keys() and all(held(staged[n]) == held(direct[n]) for n in direct)
    assert staged["tl_ward_placed"].count() == 1 and staged["tl_participant_stats"].count() == 2
    plan = staged["tl_ward_kill"]._jdf.queryExecution().toString()
    assert "from_json" not in plan and "event-WARD_KILL" in plan
    shred.write_tables(staged, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/tl_champion_kill").count() == 1


def test_staging_has_one_scan_and_one_parse(spark, tmp_path):
    raw = frame(spark, TIMELINES)
    raw.write.parquet(f"{tmp_path}/raw")
    d = shred._frames(spark.read.parquet(f"{tmp_path}/raw"), "payload")
    units = shred._units(d, ["matchid"], [("e", d["f.events"], lambda x: x["type"])])
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_findings_of_objects(spark):
    payloads = [
        {"teams": [{"id": 1, "bans": []}, {"id": 2, "extra": {"x": 1}}, 7]},
        {"teams": {"id": 1}},
        {"team": 3},
        [1, 2],
        None,
        "{cut",
        {"teams": []},
        {"teams": None},
    ]
    checks = {"teams": {"path": ["teams", "*"], "required": ["id", "bans"], "optional": ["more"]}, "notes": {"path": ["notes"], "may_lack": True}}
    got = {(r.matchid, r.object, r.path, r.kind, tuple(r.names), r["shape"]) for r in drift.object_drift(frame(spark, payloads), checks).collect()}
    assert got == {
        (0, "teams", "$.teams[1]", "missing_keys", ("bans",), "OBJECT<extra: OBJECT<x: BIGINT>, id: BIGINT>"),
        (0, "teams", "$.teams[1]", "unexpected_keys", ("extra",), "OBJECT<extra: OBJECT<x: BIGINT>, id: BIGINT>"),
        (0, "teams", "$.teams[2]", "expected_object", (), "BIGINT"),
        (1, "teams", "$.teams", "expected_list", (), "OBJECT<id: BIGINT>"),
        (2, "teams", "$", "missing_path", ("teams",), "OBJECT<team: BIGINT>"),
        (3, "teams", "$", "expected_object", (), "ARRAY<BIGINT>"),
        (4, "payload", "$", "not_json", (), None),
        (5, "payload", "$", "not_json", (), None),
        (7, "teams", "$.teams", "expected_list", (), "VOID"),
    }
    assert drift.object_drift(frame(spark, []), checks).count() == 0


def test_findings_of_events(spark):
    payloads = [{"f": [{"events": [{"type": "A", "t": 1}, {"type": "B"}, {"type": 5}, {}, "x", {"type": "A"}]}, {"events": {}}, 3]}]
    events = {"A": {"required": ["type", "t"]}}
    got = {(r.object, r.path, r.kind, tuple(r.names)) for r in drift.event_drift(frame(spark, payloads), events, ["f", "*", "events"]).collect()}
    assert got == {
        ("event", "$.f[0].events[1]", "unknown_event_type", ("B",)),
        ("event", "$.f[0].events[2]", "unknown_event_type", ()),
        ("event", "$.f[0].events[3]", "unknown_event_type", ()),
        ("event", "$.f[0].events[4]", "unknown_event_type", ()),
        ("event:A", "$.f[0].events[5]", "missing_keys", ("t",)),
        ("events", "$.f[1].events", "expected_list", ()),
        ("events", "$.f[2]", "expected_object", ()),
    }


def test_observed_paths_and_their_drift(spark):
    old = drift.observed_paths(frame(spark, [{"a": [1, {"b": True}], "c": None}, {"a": 2.5}, None]))
    got = {(r.path, r.type): r.n for r in old.collect()}
    assert got == {("$", "OBJECT"): 2, ("$", "INVALID"): 1, ("$.a", "ARRAY"): 1, ("$.a", "DECIMAL"): 1, ("$.a[*]", "BIGINT"): 1, ("$.a[*]", "OBJECT"): 1, ("$.a[*].b", "BOOLEAN"): 1, ("$.c", "VOID"): 1}
    new = drift.observed_paths(frame(spark, [{"a": [1, {"b": True, "z": "t"}]}, None]))
    assert {tuple(r) for r in drift.path_drift(new, old).collect()} == {("$.a[*].z", "STRING", "new"), ("$.a", "DECIMAL", "gone"), ("$.c", "VOID", "gone")}
    assert drift.observed_schema(frame(spark, [{"a": 1}, {"b": "x"}])).first().schema == "OBJECT<a: BIGINT, b: STRING>"
    assert drift.observed_paths(frame(spark, [])).count() == 0
