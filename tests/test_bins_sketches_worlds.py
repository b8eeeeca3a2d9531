"""Bins as tables, stored sketches, column matrices and joint worlds against plain Python; nulls and empty tables."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchforge.operators import bins, catalog, latent, sketches


def test_interval_join_with_overlaps_gaps_open_ends_and_ties(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 5.0, -3.5, rng.uniform(-50, 50), float("inf"), -1e9]) for _ in range(300)] + [None, float("nan")]
    table = [(0, None, 0.0), (1, 0.0, 5.0), (2, 4.0, 9.0), (3, 20.0, None), (4, 7.0, 7.0), (5, 3.0, 1.0)] + [(10 + i, i / 3, i / 3 + 0.5) for i in range(-60, 60)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    b = spark.createDataFrame(table, "bin int, low double, high double")
    want = {(i, n) for i, v in enumerate(values) if v is not None and not math.isnan(v) for n, lo, hi in table if (lo is None or v >= lo) and (hi is None or v < hi) and (lo is None or hi is None or lo < hi)}
    for cells in (4, 1024):
        got = [(r.id, r.bin) for r in bins.interval_join(df, b, "v", cells=cells).collect()]
        assert sorted(got) == sorted(want)
    left = bins.interval_join(df, b, "v", how="left")
    assert {r.id for r in left.collect()} == set(range(len(values))) and left.where("bin IS NULL").count() == len(values) - len({i for i, _ in want})
    assert bins.interval_join(df.where("false"), b, "v").count() == 0 and bins.interval_join(df, b.where("false"), "v").count() == 0


def test_nearest_centres_and_chained_edges(spark):
    centres = [10.0, 30.0, 20.0, 20.0, None]
    df = spark.createDataFrame([(v,) for v in (5.0, 10.0, 15.0, 20.0, 29.9, 30.0, 31.0, None)], "v double")
    got = {r.v: (r.low, r.high) for r in bins.nearest_centres(df, spark.createDataFrame([(c,) for c in centres], "centre double"), "v").collect()}
    assert got == {5.0: (10.0, 10.0), 10.0: (10.0, 10.0), 15.0: (10.0, 20.0), 20.0: (20.0, 20.0), 29.9: (20.0, 30.0), 30.0: (30.0, 30.0), 31.0: (30.0, 30.0), None: (None, None)}
    rows = spark.createDataFrame([(0.5, 3.0), (1.5, 10.0), (1.6, 14.0), (2.5, 20.0), (9.0, 1.0)], "items double, minutes double")
    b = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 3.0), (3, 3.0, 4.0), (4, 4.0, None)], "bin int, low double, high double")
    got = [tuple(r) for r in bins.chained_bins(rows, b, "items", "minutes").orderBy("bin").collect()]
    assert got == [(1, 2, 12.0, 1.0, 12.0, 6.5), (2, 1, 20.0, 12.0, 20.0, 16.0), (4, 1, 1.0, 20.0, 1.0, 10.5)]


def test_union_of_stored_sketches_is_the_sketch_of_all_rows(spark, tmp_path):
    want = [sketches.Sketch("people", "set", "who", 10), sketches.Sketch("about", "distinct", "who"), sketches.Sketch("values", "values", "v", 200)]
    df = spark.range(40_000).select((F.col("id") % 4).cast("int").alias("day"), (F.col("id") % 2).alias("team"), (F.col("id") * 7 % 20_011).alias("who"), (F.col("id") % 1000).cast("double").alias("v"))
    levels = {"team": ["team"], "all": []}
    sketches.sketch_levels(df, ["day"], levels, want).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 4 + 4  # every day has one team
    direct = sketches.united(sketches.sketch_levels(df, [], levels, want), ["level", "key"], want)
    ask = lambda t: {(r.level, r.key): tuple(r)[2:] for r in t.select("level", "key", "rows", *[sketches.distinct_estimate(s) for s in want[:2]], sketches.rank_estimate(want[2], F.lit(499.0))).collect()}
    a, b = ask(sketches.united(stored, ["level", "key"], want)), ask(direct)
    assert a.keys() == b.keys() == {("team", '{"team":0}'), ("team", '{"team":1}'), ("all", "{}")}
    exact = {k: df.where(f"team = {k[1][8]}" if k[0] == "team" else "true").select("who").distinct().count() for k in a}
    for k in a:
        assert a[k][0] == b[k][0] and a[k][2] == b[k][2]  # rows; HyperLogLog registers are the same
        assert abs(a[k][1] / exact[k] - 1) < 0.15 and abs(a[k][2] / exact[k] - 1) < 0.03 and abs(a[k][3] - 0.5) < 0.03
    both = sketches.united(stored.where("level = 'team'"), ["key"], want).agg(F.max(F.when(F.col("key") == '{"team":0}', F.col("people"))).alias("x"), F.max(F.when(F.col("key") == '{"team":1}', F.col("people"))).alias("y"))
    sizes = both.select(*[c.alias(n) for n, c in sketches.overlap("x", "y").items()]).first()
    assert abs(sizes.either / exact[("all", "{}")] - 1) < 0.15 and sizes.both + sizes.left_only <= 1.2 * sizes.either


def test_sketches_of_nulls_and_empty_tables(spark):
    want = [sketches.Sketch("n", "set", "who"), sketches.Sketch("q", "values", "v")]
    df = spark.createDataFrame([(1, None, None)], "team int, who string, v double")
    row = sketches.united(sketches.sketch_levels(df, [], {"t": ["team"]}, want), ["key"], want).select("rows", sketches.distinct_estimate(want[0]), sketches.quantile_estimate(want[1], 0.5), sketches.rank_estimate(want[1], F.lit(1.0))).first()
    assert tuple(row) == (1, 0, None, None)
    assert sketches.sketch_levels(df.where("false"), [], {"t": ["team"]}, want).count() == 0


def test_columns_of_wide_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 64)) @ np.diag(np.linspace(2, 0.1, 64))
    x[:, 7] = 3.0
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0],), ([float("nan")] * 64,), ([None] * 64,), ([float("inf")] + [0.0] * 63,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    c = np.cov(x.T, bias=True)
    got = {(r.i, r.j): r.covariance for r in latent.covariances(df, "v").collect()}
    assert len(got) == 64 * 65 // 2 and all(abs(got[i, j] - c[i, j]) < 1e-9 for i, j in got)
    e = np.maximum(np.linalg.eigvalsh(c), 0)
    s = e[e > 0] / e.sum()
    keep = [i for i in range(64) if i != 7]
    corr = np.abs(np.corrcoef(x[:, keep].T)[~np.eye(63, dtype=bool)]).mean()
    d = latent.column_diagnostics(df, "v").first()
    assert (d.rows, d.active_dims) == (500, 63) and d.effective_rank == pytest.approx(math.exp(-(s * np.log(s)).sum())) and d.mean_abs_correlation == pytest.approx(corr)
    assert latent.column_diagnostics(df.where("false"), "v").count() == 0 and latent.covariances(df.where("false"), "v").count() == 0


def test_principal_components_explain_what_numpy_says(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5)) @ np.diag([4, 3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    scores, explained = latent.pca_block(df, "id", "v", 2)
    e, q = np.linalg.eigh(np.cov(x.T))
    assert explained == pytest.approx((e[::-1] / e.sum())[:2].tolist())
    want = (x - x.mean(axis=0)) @ q[:, ::-1][:, :2]
    want = want / want.std(axis=0, ddof=1)
    got = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert got.shape == (300, 2) and np.abs(np.abs((got * want).mean(axis=0)) - (want * want).mean(axis=0)).max() < 1e-9
    empty, none = latent.pca_block(df.where("false"), "id", "v", 2)
    assert empty.count() == 0 and none == []


@pytest.mark.parametrize("slots,k,width", [(7, 3, 512), (9, 3, 64), (3, 8, 512), (1, 3, 2), (12, 2, 512)])
def test_top_choices_equal_all_products(slots, k, width):
    rng = np.random.default_rng(slots)
    ps = [np.sort(rng.choice([0.5, 0.25, rng.random(), 0.1], k))[::-1] for _ in range(slots)]
    weights, chosen = catalog.top_choices(ps, width)
    every = sorted((math.prod(c) for c in product(*[p.tolist() for p in ps])), reverse=True)[:width]
    assert weights.tolist() == pytest.approx(every)
    assert len({tuple(c) for c in chosen}) == len(chosen)
    assert [math.prod(ps[s][c] for s, c in enumerate(row)) for row in chosen] == pytest.approx(weights.tolist())


def test_joint_worlds_of_many_slots_and_of_none(spark):
    kind = "game int, slots array<array<struct<build:string,p:double>>>, note string"
    many = [[(f"a{s}", 0.6), (f"b{s}", 0.4)] for s in range(40)]
    games = [(1, many, "x"), (2, [[("a", 0.0)], [("b", 1.0)]], None), (3, [], None), (4, None, None), (5, [[("z", 0.5), ("y", 0.5)]], "t")]
    got = catalog.joint_worlds(spark.createDataFrame(games, kind), "slots", 2, 512, 2.0).collect()
    one = sorted((r for r in got if r.game == 1), key=lambda r: r.world)
    assert len(one) == 512 and len(one[0].builds) == 40 and one[0].note == "x" and one[0].weight == pytest.approx(0.6**40) and one[1].weight == pytest.approx(0.6**39 * 0.4)
    assert {r.game for r in got} == {1, 5} and [r.builds for r in got if r.game == 5] == [["y"], ["z"]]
    assert catalog.joint_worlds(spark.createDataFrame([], kind), "slots").count() == 0


def test_games_of_one_shape_are_worked_on_together(spark):
    rng = np.random.default_rng(3)
    games = [(g, [[(f"{s}{c}", float(rng.random() / 3)) for c in range(rng.integers(1, 4))] for s in range(g % 4 + 1)]) for g in range(60)]
    df = spark.createDataFrame(games, "game int, slots array<array<struct<build:string,p:double>>>").coalesce(1)
    rows = catalog.game_worlds(df, "slots", 3, 20, 0.5).collect()
    assert len(rows) == 60
    for r in rows:
        n, slots = len(r.choices), dict(games)[r.game]
        every = sorted(((math.prod(p for _, p in c), [b for b, _ in c]) for c in product(*slots)), key=lambda x: -x[0])[:20]
        mass = np.cumsum([w for w, _ in every])
        want = every[: int((mass < 0.5).sum()) + 1]
        assert r.weights == pytest.approx([w for w, _ in want])
        assert [[r.choices[s][r.picks[w * n + s]] for s in range(n)] for w in range(len(r.weights))] == [b for _, b in want]


def test_worlds_are_counted_without_a_row_each(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["cat4_joint_worlds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_content_version_follows_rows_not_their_order(spark):
    rows = [(i, f"n{i}", None if i % 3 else float(i)) for i in range(200)]
    of = lambda r: catalog.content_version(spark.createDataFrame(r, "id int, name string, p double").repartition(5), ["id", "name", "p"]).first().version
    shuffled = random.Random(1).sample(rows, len(rows))
    changed = [*rows[:-1], (199, "n199", 198.5)]
    assert of(rows) == of(shuffled) and len({of(rows), of(changed), of(rows + rows[:1]), of(rows[1:]), of([])}) == 5


def test_keys_beyond_a_sketch_are_counted_from_the_rows(spark):
    want = [sketches.Sketch("people", "set", "who", 5), sketches.Sketch("values", "values", "v", 16)]
    df = spark.range(2000).select(F.when(F.col("id") < 10, 0).otherwise(1).alias("team"), F.when(F.col("id") % 7 > 0, F.col("id") % 501).alias("who"), (F.col("id") * 13 % 997).cast("double").alias("v"))
    levels = {"team": ["team"], "all": []}
    every = sketches.united(sketches.sketch_levels(df, [], levels, want), ["level", "key"], want)
    beyond = [sketches.inexact(every, s) for s in want]
    assert all({tuple(x) for x in b.collect()} == {("team", '{"team":1}'), ("all", "{}")} for b in beyond)
    counts = {(x.level, x.key): (x.distinct, x.even) for x in sketches.exact_distinct(df, levels, "who", beyond[0], {"even": F.col("v") % 2 == 0}).collect()}
    middles = {(x.level, x.key): x.value for x in sketches.exact_quantile(df, levels, "v", 0.5, beyond[1]).collect()}
    rows = df.collect()
    for key, mine in ((("team", '{"team":1}'), [x for x in rows if x.team == 1]), (("all", "{}"), rows)):
        assert counts[key] == (len({x.who for x in mine if x.who is not None}), len({x.who for x in mine if x.who is not None and x.v % 2 == 0}))
        assert middles[key] == sorted(x.v for x in mine)[(len(mine) + 1) // 2 - 1]
    assert counts.keys() == middles.keys() and len(counts) == 2
