"""Checked writes and loads, and guards of lineage."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.operators import augment, guards
from matchforge.sources import checked

GAMES = "game long, split string, won int, kills array<int>"


def games(spark, change=lambda rows: rows):
    rows = [(i, "train" if i < 8 else "test", i % 2, [i, 1, 2]) for i in range(12)]
    return spark.createDataFrame(change(rows), GAMES)


def test_a_cache_comes_back_by_split_with_defaults(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    meta = checked.write_cache(games(spark), path, "won", {"kills": 3})
    assert meta["splits"] == {"train": 8, "test": 4}
    splits = checked.load_splits(spark, path, need=["kills"], defaults={"support": 0.5, "kills": 9}, verify=True)
    assert {n: df.count() for n, df in splits.items()} == {"train": 8, "test": 4}
    row = splits["test"].orderBy("game").first()
    assert (row.game, row.split, row.kills, row.support) == (8, "test", [8, 1, 2], [0.5] * 3)


@pytest.mark.parametrize(
    "change,says",
    [
        (lambda r: [(g, s, 2 if g == 3 else w, k) for g, s, w, k in r], "won is 0 or 1"),
        (lambda r: [(g, s, None if g == 3 else w, k) for g, s, w, k in r], "won is 0 or 1"),
        (lambda r: [(g, s, 1 if s == "test" else w, k) for g, s, w, k in r], "won of test takes both values"),
        (lambda r: [(g, "later" if g == 1 else s, w, k) for g, s, w, k in r], "split is one of"),
        (lambda r: [(g, s, w, k[:2] if g == 9 else k) for g, s, w, k in r], "kills holds 3 values"),
        (lambda r: [(g, s, w, None if g == 9 else k) for g, s, w, k in r], "kills holds 3 values"),
    ],
)
def test_rows_that_fail_are_not_published(spark, tmp_path, change, says):
    path = f"file://{tmp_path}/c"
    with pytest.raises(checked.CheckFailed, match=says):
        checked.write_cache(games(spark, change), path, "won", {"kills": 3})
    with pytest.raises(checked.CheckFailed, match="no finished cache"):
        checked.load_splits(spark, path)
    checked.write_cache(games(spark), path, "won", {"kills": 3})
    with pytest.raises(checked.CheckFailed):
        checked.write_cache(games(spark, change), path, "won", {"kills": 3})
    assert checked.load_splits(spark, path, verify=True)["train"].count() == 8  # the finished one stays


def test_loads_that_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    meta = checked.write_cache(games(spark), path, "won", {"kills": 3})
    with pytest.raises(checked.CheckFailed, match="lacks deaths"):
        checked.load_splits(spark, path, need=["kills", "deaths"])
    games(spark).write.mode("append").partitionBy("split").parquet(f"{path}/{meta['folder']}")
    with pytest.raises(checked.CheckFailed, match="rows, not"):
        checked.load_splits(spark, path, verify=True)
    text = (tmp_path / "c" / "cache.json").read_text()
    (tmp_path / "c" / "cache.json").write_text(text.replace('"format": 3', '"format": 2'))
    with pytest.raises(checked.CheckFailed, match="format 2"):
        checked.load_splits(spark, path)


def test_checks_ride_along_with_a_pass(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "v double")
    seen = []
    with pytest.raises(checked.CheckFailed, match="v lies in 0..2"):
        checked.checked(df, [checked.in_range("v", 0, 2), checked.rows_are(4)], lambda d: seen.append(d.count()))
    assert seen == [4]
    got = checked.checked(df.where("false"), [checked.rows_are(0), checked.binary("v")], lambda d: d.collect(), {"most": F.max("v")})
    assert got["rows"] == 0 and got["most"] is None


def test_sources_of_columns(spark):
    a = spark.createDataFrame([(1, "TOP", "b", 2.0)], "championid int, teamposition string, build string, gold double")
    b = spark.createDataFrame([(1, 5)], "championid int, challenge_x int")
    step = a.withColumn("x", F.concat("build", F.lit("!"))).withColumn("y", F.length("x") + F.col("gold")).withColumn("r", F.row_number().over(Window.partitionBy("championid").orderBy("x")))
    got = guards.column_sources(step.join(b, "championid").select("y", "r", F.explode(F.array("gold", F.lit(1.0))).alias("g"), F.col("challenge_x").alias("c"), "championid"))
    assert got["y"] == {"build", "gold"} and {"championid", "build"} <= got["r"] and got["g"] == {"gold"} and got["c"] == {"challenge_x"} and got["championid"] == {"championid"}
    both = a.select("gold").unionByName(a.select(F.length("build").cast("double").alias("gold")))
    assert guards.column_sources(both)["gold"] == {"gold", "build"}
    batches = a.select("gold", "build").mapInArrow(lambda it: it, "gold double, build string")
    assert guards.column_sources(batches)["gold"] == {"gold", "build"}
    agg = step.groupBy("championid").agg(F.max("y").alias("m"), F.count("*").alias("n"))
    assert guards.column_sources(agg) == {"championid": {"championid"}, "m": {"build", "gold"}, "n": set()}


def test_guards(spark):
    a = spark.createDataFrame([(1, "TOP", "b", 2.0, 3)], "championid int, teamposition string, build string, gold double, challenge_y int")
    fine = a.groupBy("championid", "teamposition").agg(F.avg("gold").alias("gold"))
    guards.assert_pregame(fine, ["championid", "teamposition"])
    guards.assert_no_challenges(fine)
    with pytest.raises(guards.Leak, match="hidden follows from build"):
        guards.assert_pregame(fine.join(a.select("championid", F.upper("build").alias("hidden")), "championid"), ["championid", "teamposition"])
    with pytest.raises(guards.Leak, match="pregame keys are"):
        guards.assert_pregame(fine, ["championid", "teamposition", "build"])
    with pytest.raises(guards.Leak, match="whole number"):
        guards.assert_pregame(fine.withColumn("championid", F.col("championid").cast("string")), ["championid", "teamposition"])
    with pytest.raises(guards.Leak, match="challenge_y"):
        guards.assert_no_challenges(a.select((F.col("challenge_y") * 2).alias("plain")))
    assert guards.accepted_build_source("rl_candidate") == "rl_candidate"
    with pytest.raises(guards.Leak):
        guards.accepted_build_source("oracle_observed_build")
    with pytest.raises(ValueError, match="unknown"):
        guards.accepted_build_source("x")


def test_level_matrix_with_blocks_and_repeated_keys(spark):
    level = spark.createDataFrame([(1, "TOP", 2.0, None), (1, "TOP", 1.0, 9.0), (2, "MID", None, None)], "championid int, teamposition string, a double, b double")
    context = spark.createDataFrame([(1, "TOP", 7.0, None)], "championid int, teamposition string, c double, d double")
    static = spark.createDataFrame([(1, 4.0), (2, 5.0), (2, 6.0)], "championid int, hp double")
    got = {r.championid: (r.features, r.context, r.static) for r in augment.level_matrix(level, ["championid", "teamposition"], ["a", "b"], context, static).collect()}
    assert got == {1: ([1.0, 9.0], [7.0, 0.0], [4.0]), 2: ([0.0, 0.0], [0.0, 0.0], [5.0])}
    assert augment.level_matrix(level.where("false"), ["championid"], ["a"]).count() == 0
