"""Replacing tables (grains, deletes, recovery) and exact selection, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from matchforge.operators import selection
from matchforge.sources.replacing import ReplacingTable

ROWS = "id long, name string, at int, extra string"


def table(spark, tmp_path, **how):
    return ReplacingTable(spark, f"file://{tmp_path}/t", **({"key": ["id"], "version": ["at"], "buckets": 4} | how))


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_newest_version_of_a_key_stays(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 5, None), (2, "b", 1, "x"), (None, "n", 1, None), (1, "old", 4, None)], ROWS))
    t.merge(spark.createDataFrame([(1, "older", 3, None), (2, "c", 2, None), (None, "m", 2, "y"), (3, "d", None, "z")], ROWS))
    assert held(t.read()) == sorted([(1, "a", 5, None), (2, "c", 2, None), (None, "m", 2, "y"), (3, "d", None, "z")], key=repr)
    assert len(held(t.read(version=1))) == 3  # the version before can still be read
    t.merge(spark.createDataFrame([], ROWS))
    assert t.read().count() == 4


def test_later_write_wins_without_a_version_and_ties_agree(spark, tmp_path):
    t = table(spark, tmp_path, version=None)
    t.merge(spark.createDataFrame([(1, "a", 9, None)], ROWS))
    t.merge(spark.createDataFrame([(1, "b", 0, None)], ROWS))
    assert held(t.read()) == [(1, "b", 0, None)]
    twice = [(7, f"v{i}", 1, None) for i in range(20)]
    kept = set()
    for seed in (1, 2):
        u = table(spark, tmp_path / str(seed))
        u.merge(spark.createDataFrame(random.Random(seed).sample(twice, 20), ROWS).repartition(5))
        kept.add(held(u.read())[0])
    assert len(kept) == 1


def test_only_touched_slices_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.merge(spark.range(1000).select("id", F.lit("a").alias("name"), F.lit(1).alias("at"), F.lit(None).cast("string").alias("extra")))
    before = t._manifest()["slices"]
    t.merge(spark.createDataFrame([(5, "new", 2, None)], ROWS))
    t.delete(spark.createDataFrame([(5,)], "id long"))
    t.delete(F.col("id") == 77)
    after = t._manifest()["slices"]
    assert sum(before[k] != after[k] for k in before) in (1, 2) and t.read().count() == 998
    t.delete(F.lit(True))
    assert t.read().count() == 0 and t._manifest()["slices"] == {}


def test_deletes_take_nulls_as_values(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, None, 1, None), (2, "b", 1, None), (None, "c", 1, None)], ROWS))
    t.delete(spark.createDataFrame([(None,)], "name string"))
    assert [r[0] for r in held(t.read())] == [2, None]
    t.delete(F.col("id") > 0)  # unknown is not true
    assert [r[0] for r in held(t.read())] == [None]


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(i, "a", 1, None) for i in range(50)], ROWS))
    bad = spark.createDataFrame([(i, "b", 2, None) for i in range(50)], ROWS).withColumn("name", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    for write in (t.merge, t.replace_all):
        with pytest.raises(Exception, match="lost"):
            write(bad)
    again = table(spark, tmp_path)
    assert {r.name for r in again.read().collect()} == {"a"} and again.versions() == [1]
    again.replace_all(spark.createDataFrame([(1, "c", 1, None)], ROWS))
    reader = again.read()
    assert again.vacuum() >= 4 and held(reader) == [(1, "c", 1, None)] and again.versions() == [2]


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1, None)], ROWS))
    stale = t._manifest()
    t.merge(spark.createDataFrame([(2, "a", 1, None)], ROWS))
    with pytest.raises(RuntimeError):
        t._publish(stale, t.read().schema, {})
    assert t.read().count() == 2
    with pytest.raises(ValueError):
        table(spark, tmp_path / "none").read()


def test_partitions_open_their_folders_only(spark, tmp_path):
    t = table(spark, tmp_path, key=["id", "name"], partition=F.col("name"), buckets=2)
    t.merge(spark.createDataFrame([(i, n, 1, None) for i in range(20) for n in ("x/1", "y z", None)], ROWS))
    rows = t.read(partitions=["x/1"])
    assert rows.count() == 20 and {r.name for r in rows.collect()} == {"x/1"} and len(rows.inputFiles()) <= 2
    assert t.latest_run("name", "at").count() == 20  # the greatest of equal stamps


# -- selection


@pytest.mark.parametrize("kind", ["double", "long", "string", "timestamp", "boolean"])
@pytest.mark.parametrize("rounds", [1, 2])
def test_values_at_every_rank(spark, kind, rounds):
    rng = random.Random(4)
    make = {
        "double": lambda: rng.choice([0.0, 0.0, 1e-300, -5.5, 1e300, float("inf"), rng.random()]),
        "long": lambda: rng.choice([7, 2**62 + rng.randint(0, 3), -(2**60), rng.randint(-50, 50)]),
        "string": lambda: rng.choice(["", "EUW1_", f"EUW1_{rng.randint(0, 10**9)}", "EUW1_1234567890123", "Zé", "EUW1_12345678901239"]),
        "timestamp": lambda: rng.randint(0, 10**15),
        "boolean": lambda: rng.random() < 0.5,
    }[kind]
    rows = [(p, make()) for p in ("a", None, "c") for _ in range(60)] + [("a", None)] * 3 + [("one", make())]
    df = spark.createDataFrame(rows, f"p string, v {'long' if kind == 'timestamp' else kind}")
    if kind == "timestamp":
        df = df.withColumn("v", F.timestamp_micros("v"))
    sizes = {}
    for p, _ in rows:
        sizes[p] = sizes.get(p, 0) + 1
    ranks = {str(k): (lambda n, k=k: F.lit(k)) for k in range(1, max(sizes.values()) + 3)}
    few = {k: f for k, f in ranks.items() if int(k) % 9 == 1}
    got = {(r[0], int(r[1])): r for r in selection.values_at(df, ["p"], "v", ranks, rounds).collect()}
    assert {(r[0], int(r[1]), r[3]) for r in selection.values_at(df, ["p"], "v", few, rounds).collect()} == {(p, k, r[3]) for (p, k), r in got.items() if k % 9 == 1}
    for p, n in sizes.items():
        vs = sorted((v for q, v in rows if q == p), key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v))
        for k in range(1, n + 1):
            r = got.pop((p, k))
            value = r.value if kind != "timestamp" or r.value is None else round(r.value.timestamp() * 1e6)
            assert value == vs[k - 1] and r.left == k - vs.index(vs[k - 1])
    assert not got


def test_quantiles_of_ties_nulls_and_not_a_number(spark):
    rows = [("a", float(v)) for v in (5, 1, 3, 3, 9, 2)] + [("b", 4.0), (None, 7.0), ("n", None), ("m", float("nan")), ("m", 1.0), ("m", 2.0), ("m", None), ("i", float("inf")), ("i", float("inf"))]
    df = spark.createDataFrame(rows, "p string, v double")
    q = {r.p: (r.low, r.mid) for r in selection.quantiles(df, ["p"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    assert q == {"a": (pytest.approx(1.5), pytest.approx(3.0)), "b": (4.0, 4.0), None: (7.0, 7.0), "m": (pytest.approx(1.2), 2.0), "i": (float("inf"),) * 2}
    assert selection.quantiles(df.where("false"), ["p"], "v", {"x": 0.5}).count() == 0
    assert {(r.p, r.v) for r in selection.middle_rows(df.where("p IN ('a', 'm')"), ["p"], "v").collect()} == {("a", 3.0), ("m", 2.0)}


def test_a_value_that_all_rows_share_is_one_row_of_the_last_shuffle(spark):
    df = spark.range(2_000_000).select(F.lit("p").alias("p"), F.when(F.col("id") < 1_900_000, 0.0).otherwise(F.rand(3)).alias("v"))
    got = selection.quantiles(df, ["p"], "v", {"x": 0.25, "y": 0.5})
    assert got.first().asDict() == {"p": "p", "x": 0.0, "y": 0.0}
    assert selection.chrono_split(df.withColumn("id", F.monotonically_increasing_id()), ["p"], ["v", "id"]).where("split = 'train'").count() == 1_600_000


def test_chrono_split_of_small_parts(spark):
    df = spark.createDataFrame([(1, i, None) for i in range(5)] + [(2, 0, None), (None, 3, "x"), (None, None, "y")], "p int, t int, x string")
    got = {(r.p, r.t): r.split for r in selection.chrono_split(df, ["p"], ["t"]).collect()}
    assert got == {(1, 0): "train", (1, 1): "train", (1, 2): "train", (1, 3): "train", (1, 4): "test", (2, 0): "train", (None, None): "train", (None, 3): "test"}
    assert selection.chrono_split(df.where("false"), ["p"], ["t"]).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 7, 100])
def test_equal_ranges_of_texts(spark, parts):
    ids = sorted({f"EUW1_{i * 7919 % 100_003}" for i in range(60)})
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id string")
    want = {}
    for i, k in enumerate(ids):
        want.setdefault(i * parts // len(ids), []).append(k)
    got = {r.part: (r.low, r.high, r.n) for r in selection.equal_ranges(df, "id", parts).collect()}
    assert got == {p: (v[0], v[-1], len(v)) for p, v in want.items()}
    assert selection.equal_ranges(df.where("false"), "id", parts).count() == 0
