"""Own metrics and scores, smoothing by levels, corrected statistics and vector spaces against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchforge.functions import hooks
from matchforge.operators import augment, correction, hierarchy, joins, profiles, spaces


def test_metrics_come_in_the_order_of_their_dependencies(spark):
    own = hooks.MetricRegistry()
    own.register("b", lambda a, x: a * x, ["a", "x"])  # registered before what it needs
    own.register("a", lambda k: k + 1, ["takedowns_to_deaths_ratio"], "minutes")
    assert own.order() == ["takedowns_to_deaths_ratio", "a", "b"] and own.columns() == ["b", "a"]
    assert own.inputs(["b"]) == {"kills", "assists", "deaths", "x"}
    row = own.add(spark.createDataFrame([(2, 4, 3, 10.0)], "kills int, assists int, deaths int, x double"), ["b"]).first()
    assert (row.a, row.b) == (3.0, 30.0)
    with pytest.raises(ValueError, match="missing"):
        own.add(spark.createDataFrame([(1,)], "kills int"))
    with pytest.raises(ValueError, match="already"):
        own.register("a", lambda k: k, ["x"])
    with pytest.raises(ValueError, match="evidence"):
        own.register("c", lambda k: k, ["x"], "games")
    own.register("p", lambda q: q, ["q"])
    with pytest.raises(ValueError, match="depend on each other"):
        own.register("q", lambda p: p, ["p"])
    assert "q" not in own.metrics


def test_a_version_follows_the_definition(spark):
    def made(fn, deps=("x", "y"), evidence="matchups"):
        own = hooks.MetricRegistry()
        own.register("m", fn, list(deps), evidence)
        return own.version()

    one = made(lambda x, y: x + y)
    assert one == made(lambda a, b: a + b)
    assert len({one, made(lambda x, y: x - y), made(lambda x, y: x + y, ("y", "x")), made(lambda x, y: x + y, evidence="minutes")}) == 4


def test_scores_of_columns_functions_and_udfs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")

    @F.pandas_udf("double")
    def twice(a: pd.Series, b: pd.Series) -> pd.Series:
        return 2 * a.fillna(0) + b

    assert [r.score for r in hooks.score(df, F.col("b") * 2).collect()] == [4.0, 6.0]
    assert [r.score for r in hooks.score(df, twice, ["a", "b"]).collect()] == [4.0, 3.0]
    assert [r.p for r in hooks.score(df, lambda a: F.coalesce(a, F.lit(0.5)), ["a"], "p").collect()] == [1.0, 0.5]
    assert [r.score for r in hooks.score(df, lambda d: d.withColumn("score", F.col("b"))).collect()] == [2.0, 3.0]
    with pytest.raises(ValueError):
        hooks.score(df, lambda d: d)


LEVELS = [hierarchy.Level("slot", ["champ", "role"], 10.0), hierarchy.Level("style", ["role", "build"], 5.0)]


def smoothed_by_hand(base, mode, apart):
    """{identity: (rate, per minute)} of (champ, role, build): (n, minutes, a, b)."""
    out = {}
    for key, (n, t, a, b) in base.items():
        strong = math.sqrt(1 + 50 / max(n, 1))
        held = []
        for name, pick, cap in (("slot", (0, 1), 10), ("style", (1, 2), 5)):
            rows = [v for k, v in base.items() if all(k[i] == key[i] for i in pick)]
            valid = not (name == "style" and key[1] in apart)
            sums = [sum(c) for c in zip(*rows)]
            held.append((valid, sums, (min(sums[0], cap) * strong if valid else 0, min(200 * sums[0], 200 * cap) * strong if valid else 0)))
        weights = [w for _, _, w in held]
        if mode == "cascade":
            chosen = next((i for i, (v, s, _) in enumerate(held) if v and s[0] >= 50), None)
            if chosen is None:
                chosen = next((i for i in (1, 0) if held[i][0]), None)
            total = [sum(w[j] for w in weights) for j in (0, 1)]
            weights = [tuple(total) if i == chosen else (0, 0) for i in range(2)]
        top, low = [a, b if t > 0 else 0], [n, t]
        for (_, s, _), w in zip(held, weights):
            for j, per in enumerate((s[0], s[1])):
                top[j] += w[j] * (s[2 + j] / per if per else 0)
                low[j] += w[j]
        out[key] = tuple(x / y if y else 0.0 for x, y in zip(top, low))
    return out


@pytest.mark.parametrize("mode", ["cascade", "additive"])
def test_smoothing_by_levels_against_plain_python(spark, mode):
    rng = np.random.default_rng(8)
    base = {(c, r, b): (int(rng.integers(1, 40)), float(rng.integers(0, 3)) * 20, float(rng.integers(0, 90)), float(rng.integers(0, 500))) for c in range(6) for r in ("TOP", "JUNGLE", None) for b in ("x", "y")}
    rows = [(*k, n, t, [a, b]) for k, (n, t, a, b) in base.items()]
    df = spark.createDataFrame(rows, "champ int, role string, build string, matchups long, minutes double, sums array<double>")
    got = hierarchy.smooth(df, ["champ", "role", "build"], LEVELS, ["a"], ["b"], mode, isolated=("role", ("JUNGLE",), ("style",)))
    want = smoothed_by_hand(base, mode, ("JUNGLE",))
    held = {(r.champ, r.role, r.build): (r.a, r.b) for r in got.collect()}
    assert held.keys() == want.keys()
    for k in want:
        assert held[k] == pytest.approx(want[k]), k
    assert hierarchy.smooth(df.where("false"), ["champ", "role", "build"], LEVELS, ["a"], ["b"], mode, isolated=None).count() == 0
    with pytest.raises(ValueError):
        hierarchy.smooth(df, ["champ"], LEVELS, ["a"], ["b"], "other")


def test_looked_up_keys_that_are_missing_find_no_level(spark):
    df = spark.createDataFrame([(1, "s", 10, 10.0, [20.0]), (1, "l", 90, 10.0, [900.0]), (1, "z", 4, 1.0, [4.0])], "champ int, build string, matchups long, minutes double, sums array<double>")
    other = F.when(F.col("build") == "s", "l").when(F.col("build") == "l", "s")
    got = {r.build: r.a for r in hierarchy.smooth(df, ["champ", "build"], [hierarchy.Level("sibling", ["champ", "build"], 20.0, {"build": other})], ["a"], [], isolated=None).collect()}
    w = 20 * math.sqrt(1 + 50 / 10)
    assert got["s"] == pytest.approx((20 + w * 10) / (10 + w)) and got["z"] == 1.0


def test_corrected_statistics_of_one_match(spark):
    info = spark.createDataFrame([("m", 2, 1000), ("short", 2, 990), ("old", 1, 2000)], "matchid string, season int, gameduration int")
    matches = correction.population(info)
    assert [r.matchid for r in matches.collect()] == ["m"]
    ends = spark.createDataFrame([("m", 100_000), ("m", 99_000), ("old", 5)], "matchid string, timestamp long")
    tail = correction.tails(ends, matches)
    assert [tuple(r) for r in tail.collect()] == [("m", 85_000)]
    kill = "matchid string, timestamp long, champion_kill_event_id string, killerId int, victimId int, assistingParticipantIds array<int>"
    kills = spark.createDataFrame([("m", 90_000, "e1", 1, 2, [3, 4]), ("m", 90_000, "e1", 1, 2, [3, 4]), ("m", 85_000, "e2", 0, 2, None), ("m", 84_999, "e3", 5, 6, [7]), ("old", 5, "e4", 1, 2, [])], kill)
    damage = "matchid string, champion_kill_event_id string, participantId int, physicalDamage int, magicDamage int, trueDamage int"
    received = spark.createDataFrame([("m", "e1", 1, 10, 20, 30), ("m", "e1", 0, 1, 1, 1), ("m", "e3", 5, 9, 9, 9), ("m", "e2", 3, 4, None, 2)], damage)
    dealt = spark.createDataFrame([("m", "e1", 1, 100, 0, 7)], damage)
    item = "matchid string, frame_timestamp long, timestamp long, participantId int, itemId int"
    bought = spark.createDataFrame([("m", 60_000, 90_000, 1, 11), ("m", 60_000, 90_000, 1, 11), ("m", 60_000, 90_001, 1, 12)], item)
    sold = spark.createDataFrame([("m", 60_000, 95_000, 1, 11)], item)
    undone = spark.createDataFrame([("m", 60_000, 95_500, 2, 40), ("m", 60_000, 95_500, 2, 50)], "matchid string, frame_timestamp long, timestamp long, participantId int, goldGain int")
    prices = spark.createDataFrame([(11, 1003)], "itemid long, price long")
    deltas = correction.delta_totals(tail, kills, dealt, received, bought, sold, undone, prices)
    got = {r.participantid: {d: r[d] for d in correction.DELTAS if r[d]} for r in deltas.collect()}
    assert got == {
        1: {"kills": 1, "physical_dealt": 10, "magic_dealt": 20, "true_dealt": 30, "physical_taken": 100, "true_taken": 7, "goldspent": 1003 - 702},
        2: {"deaths": 2, "physical_taken": 10 + 1 + 4, "magic_taken": 21, "true_taken": 30 + 1 + 2, "physical_dealt": 100, "true_dealt": 7, "goldspent": -40},
        3: {"assists": 1, "physical_dealt": 4, "true_dealt": 2},
        4: {"assists": 1},
    }
    columns = ", ".join(f"{c} int" for c in correction.CORRECTED)
    stats = spark.createDataFrame([("m", 1, *[50] * 12, "x"), ("m", 9, *[5] * 12, None), ("old", 1, *[5] * 12, None)], f"matchid string, participantid int, {columns}, note string")
    out = {r.participantid: r for r in correction.corrected_statistics(stats, matches, deltas).collect()}
    assert set(out) == {1, 9} and out[9].kills == 5 and out[1].note == "x"
    assert (out[1].kills, out[1].totaldamagedealttochampions, out[1].magicdamagedealttochampions, out[1].totaldamagetaken, out[1].physicaldamagetaken, out[1].magicdamagetaken, out[1].goldspent) == (49, 0, 30, 0, 0, 50, 0)


def test_agreement_of_spaces_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    y = x[:, :4] + 0.3 * rng.standard_normal((300, 4))
    x[17], y[17] = x[40], y[40]  # a tie
    good = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    bad = [(1000, None, [0.0] * 4), (1020, [float("nan")] * 8, [0.0] * 4), (1040, [1.0] * 7, [0.0] * 4), (None, [0.0] * 8, [0.0] * 4), (1060, [None] * 8, [0.0] * 4)]
    df = spark.createDataFrame(good + bad, "id long, x array<double>, y array<double>").repartition(4)
    dist = lambda m: np.sqrt(((m[::20][:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    dx, dy, ids = dist(x), dist(y), np.arange(300)
    share, u, v = [], [], []
    for q in range(15):
        other = ids != 20 * q
        near = [set(ids[other][np.lexsort((ids[other], d[q][other]))[:10]]) for d in (dx, dy)]
        share.append(len(near[0] & near[1]) / 10)
        u.append(dx[q][other])
        v.append(dy[q][other])
    got = spaces.neighbour_agreement(df, "id", "x", "y").first()
    assert (got.queries, got.pairs) == (15, 15 * 299) and got.recall == pytest.approx(np.mean(share))
    assert got.distance_correlation == pytest.approx(np.corrcoef(np.concatenate(u), np.concatenate(v))[0, 1])
    none = spaces.neighbour_agreement(df.where("false"), "id", "x", "y").first()
    assert none.queries == 0 and none.recall is None


def test_dictionaries_and_vocabularies_by_join(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", None]), (1, ["a", "b", "a", None]), (2, None), (3, [])], "k int, items array<string>")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "item string")
    assert sorted((r.k, r.n) for r in joins.known_items(df, known, "items", "item", "n").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    entries = spark.createDataFrame([(1, "z", 5), (1, "a", 9), (2, None, 1)], "k int, name string, v int")
    held = {r.k: (r.name, r.v, r.found) for r in joins.Dictionary(entries, ["k"], {"name": "?", "v": 0}).look_up(df.select("k").distinct(), {"k": "k"}).collect()}
    assert held == {1: ("a", 9, 1), 2: (None, 1, 1), 3: ("?", 0, 0)}
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string")
    got = sorted((r.w or "", r.i) for r in augment.vocabulary_ids(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "w string"), words, "w", "i").collect())
    assert got == [("", 2), ("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("nested", [True, False])
def test_bundle_of_priors_against_plain_python(spark, nested):
    from matchforge.operators import bundle

    rng = np.random.default_rng(4)
    players = [(m, 100 if s < 2 else 200, s, int(rng.integers(0, 3)), ("TOP", None)[s % 2], rng.choice(["x", "y"]).item(), int((s < 2) == (m % 3 > 0))) for m in range(40) for s in range(4)]
    rows = spark.createDataFrame(players, "matchid int, teamid int, participantid int, championid int, teamposition string, build string, win int")
    past = [p for p in players if p[0] < 30]
    got = bundle.prior_features(rows, rows.where("matchid < 30"), ["build", "champion"], ["build", "champion"], nested=nested, versus_strength=5.0, pair_strength=7.0).collect()
    keys = {"build": lambda p: (p[3], p[4] or "", p[5]), "champion": lambda p: (p[3],)}
    solo = {}
    for p in past:
        n, w = solo.get(keys["build"](p), (0, 0))
        solo[keys["build"](p)] = (n + 1, w + p[6])

    def own(p):
        n, w = solo.get(keys["build"](p), (0, 0))
        return (0.5 * 20 + w) / (20 + n), n

    def cells(kind, key):
        held = {}
        for a in past:
            for b in past:
                if a[0] == b[0] and ((kind == "versus" and a[1] == 100 and b[1] == 200) or (kind == "pair" and a[1] == b[1] and a[2] < b[2])):
                    x, y, w = key(a), key(b), a[6]
                    if x > y:
                        x, y, w = y, x, (1 - w if kind == "versus" else w)
                    if x == y and kind == "versus":
                        w = 0.5
                    held.setdefault((x, y), []).append(w)
        return held

    tables = {(kind, k): cells(kind, f) for kind in ("versus", "pair") for k, f in keys.items()}
    want = {}
    for a in players:
        want[a[0], "solo", a[2], None] = own(a)
        for b in players:
            kind = "versus" if a[1] == 100 and b[1] == 200 else "pair" if a[1] == b[1] and a[2] < b[2] else None
            if a[0] != b[0] or kind is None:
                continue
            s1, s2 = own(a)[0], own(b)[0]
            value, strength, e, n_fine = (0.5 + (s1 - s2) / 2, 5.0, 0.0, 0) if kind == "versus" else ((s1 + s2) / 2, 7.0, 0.0, 0)
            for k in ("champion", "build"):
                x, y = keys[k](a), keys[k](b)
                seen = tables[kind, k].get((min(x, y), max(x, y)), [])
                n, r = len(seen), (np.mean(seen) if seen else 0.5)
                r = 1 - r if kind == "versus" and x > y else r
                value, e, n_fine = value + (r - value) * n / (n + strength), n + strength / (n + strength) * e, n
            want[a[0], kind, a[2], b[2]] = (value, e if nested else n_fine)
    held = {(r.matchid, r.kind, r.slot, r.other): (r.value, r.n) for r in got}
    assert held.keys() == want.keys()
    for k in want:
        assert held[k] == pytest.approx(want[k]), k


def test_shares_and_opponents_need_one_window_each(spark):
    p = spark.createDataFrame([(1, 1, 100, "TOP", 3, 0), (1, 2, 200, "TOP", 1, 0), (1, 3, 100, "JUNGLE", 1, 0), (2, 1, 100, "TOP", 5, 2)], "matchid int, participantid int, teamid int, teamposition string, kills int, gold int")
    shared = profiles.team_shares(p, ["kills", "gold"])
    got = {(r.matchid, r.participantid): (r.kills_share, r.kills_concentration, r.gold_share, r.gold_concentration) for r in shared.collect()}
    assert got == {(1, 1): (0.75, 0.625, 0.0, 0.0), (1, 2): (1.0, 1.0, 0.0, 0.0), (1, 3): (0.25, 0.625, 0.0, 0.0), (2, 1): (1.0, 1.0, 1.0, 1.0)}
    duel = profiles.versus_opponent(shared, ["kills", "kills_share"])
    assert {(r.participantid, r.kills_diff, r.kills_advantage, r.kills_share_diff, r.kills_share_advantage) for r in duel.collect()} == {(1, 2.0, 0.5, -0.25, -0.25 / 1.75), (2, -2.0, -0.5, 0.25, 0.25 / 1.75)}
    assert duel._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
