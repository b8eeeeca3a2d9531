"""Registered queries of sources, sinks and latent blocks: tables written to the shared folder by the sinks and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchforge.functions import derived
from matchforge.operators import augment, guards, latent, profiles
from matchforge.plans.adapters import RAW, WIDE, split_players, table, wide_players
from matchforge.plans.metric_queries import AXES, _axes, off
from matchforge.plans.queries import FIELDS, TRAIN, WITH_SPLIT, query, r
from matchforge.sources import checked, readers
from matchforge.sources.replacing import ReplacingTable
from matchforge.sources.scratch import shared_path


_path = shared_path


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size END, -1)::INT AS size, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'none') AS brand FROM part")
def src2_json_lines_defaults(spark, d):
    path = _path(spark, "jsonl")
    p = table(spark, d, "part")
    p.select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand")).write.json(path)
    return readers.read_jsonl(spark, path, "p_partkey long, size int, brand string", {"size": -1, "brand": "none"})


@query("SELECT p_partkey, p_retailprice AS armor_flat, (p_size / 10.0)::DOUBLE AS \"armor_perLevel\", round(p_retailprice + 17 * (p_size / 10.0)::DOUBLE, 6) AS armor_at_18 FROM part")
def src3_nested_statistics(spark, d):
    """Nested statistics of JSON lines as flat columns, with their values at the last level (PRO-12)."""
    path = _path(spark, "nested")
    p = table(spark, d, "part")
    p.select("p_partkey", F.struct(F.col("p_retailprice").alias("flat"), (F.col("p_size") / 10.0).alias("perLevel")).alias("armor")).write.json(path)
    rows = readers.read_jsonl(spark, path, "p_partkey long, armor struct<flat:double,perLevel:double>")
    flat = readers.flatten_stats(rows, ["armor"])
    return profiles.static_champion(flat).withColumn("armor_at_18", r("armor_at_18"))


@query("SELECT o_orderkey, 'r1' AS run_id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'r2' FROM orders WHERE o_orderkey % 2 = 1")
def src6_append_runs(spark, d):
    """Runs are appended under their own stamp; one that is written twice stands there once."""
    path, o = _path(spark, "runs"), table(spark, d, "orders").select("o_orderkey")
    for run, rest in (("r1", 0), ("r2", 1), ("r1", 0)):
        readers.append_run(o.where(F.col("o_orderkey") % 2 == rest), path, run)
    return spark.read.schema("o_orderkey long, run_id string").parquet(path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0")
def src7_full_refresh(spark, d):
    """Truncate and insert in one step (SRC-7); then rows of some customers are deleted, in the slices that hold them (SRC-8)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    held = ReplacingTable(spark, _path(spark, "refresh"), ["o_orderkey"], buckets=8)
    held.replace_all(o.where("o_custkey % 2 = 1"))
    held.replace_all(o)
    held.delete(o.where("o_custkey % 2 = 1").select("o_custkey"))
    return held.read()


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 3)")
def src8_delete_touched(spark, d):
    """Matches of some players are deleted by id; slices without such a match keep their files."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    held = ReplacingTable(spark, _path(spark, "delete"), ["o_orderkey"], buckets=16)
    held.merge(o)
    held.delete(table(spark, d, "lineitem").where("l_suppkey % 10 = 3").select(F.col("l_orderkey").alias("o_orderkey")))
    return held.read()


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def src9_backup(spark, d):
    path, o = _path(spark, "backup"), table(spark, d, "orders").select("o_custkey", "o_orderkey")
    ids = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    readers.backup_subset(o, ids, "o_custkey", path)
    return spark.read.parquet(path)


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def src10_replacing_table(spark, d):
    """One row per entity across all runs: the newest stays, after three batches of which the last brings older rows again."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    held = ReplacingTable(spark, _path(spark, "entities"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], buckets=16)
    for rest in (1, 2, 0):
        held.merge(o.where(F.col("o_orderkey") % 3 == rest))
    held.merge(o.where("year(o_orderdate) = 1993"))
    return held.read().select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_orderdate, max(o_orderkey) AS run_id, count(*) AS seen FROM orders WHERE year(o_orderdate) IN (1994, 1996) GROUP BY ALL")
def src10_versioned_rows(spark, d):
    """Versions are rows: the key ends in the time and the run; partitioned by year, of which two are read."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("run_id"))
    held = ReplacingTable(spark, _path(spark, "versions"), ["o_custkey", "o_orderpriority", "o_orderdate", "run_id"], partition=F.year("o_orderdate"), buckets=2)
    held.merge(o)
    held.merge(o.where("run_id % 5 = 0"))  # sent again: nothing doubles
    rows = held.read(partitions=[1994, 1996])
    return rows.groupBy("o_custkey", "o_orderpriority", "o_orderdate").agg(F.max("run_id").alias("run_id"), F.count("*").alias("seen"))


@query("SELECT year(o_orderdate)::INT AS run_id, o_custkey, max(o_totalprice) AS o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY ALL")
def src10_run_snapshots(spark, d):
    """Snapshots by run: the key leads with the run, readers take the newest run only, older runs are deleted."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("run_id"), "o_custkey", "o_totalprice", F.year("o_orderdate").alias("stored_at"))
    held = ReplacingTable(spark, _path(spark, "snapshots"), ["run_id", "o_custkey"], ["stored_at", "o_totalprice"], buckets=8)
    held.merge(o.where("run_id % 2 = 0"))
    held.merge(o)
    held.delete(F.col("run_id") < 1995)
    return held.latest_run("run_id", "stored_at").drop("stored_at")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS day_year FROM orders WHERE year(o_orderdate) >= 1997")
def src11_date_partitions(spark, d):
    """Rows partitioned by date; a predicate on the date prunes folders."""
    path = _path(spark, "by-date")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("day_year"))
    readers.overwrite(o, path, ["day_year"])
    return spark.read.schema("o_orderkey long, day_year int").parquet(path).where("day_year >= 1997")


@query("WITH " + WIDE + ", g AS (SELECT matchid FROM wide GROUP BY matchid HAVING count(*) = 10) SELECT matchid, array_to_string(list(championid ORDER BY teamid, participantid), ',') AS champions, array_to_string(list(kills ORDER BY teamid, participantid), ',') AS kills FROM wide SEMI JOIN g USING (matchid) GROUP BY matchid")
def src12_array_cache(spark, d):
    """Arrays of ten per match, written once and loaded again with the columns that are wanted."""
    path = _path(spark, "arrays")
    rows = wide_players(spark, d).groupBy("matchid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("teamid", "participantid", "championid", "kills", "deaths"))).alias("s")).where("n = 10")
    cache = rows.select("matchid", *[F.col("s").getField(c).alias(c) for c in ("championid", "kills", "deaths")])
    readers.overwrite(cache, path)
    return readers.table(spark, path, ["matchid", "championid", "kills"]).select("matchid", F.array_join("championid", ",").alias("champions"), F.array_join("kills", ",").alias("kills"))


@query("WITH " + WIDE + AXES + " SELECT matchid, participantid, round(coalesce(physical, 0) + 1e-9::DOUBLE, 6) AS physical, round(coalesce(damage, 0) + 1e-9::DOUBLE, 6) AS damage, (physical IS NOT NULL)::INT AS known FROM wide LEFT JOIN (SELECT * FROM ax WHERE championid % 5 > 0) USING (championid, teamposition, build)")
def pro19_semantic_lookup(spark, d):
    """Context axes of each participant's identity; zeros for identities that have none."""
    known = _axes(spark, d).where("championid % 5 > 0").select(*FIELDS[:3], "physical", "damage", F.lit(1).alias("known"))
    rows = wide_players(spark, d).select("matchid", "participantid", *FIELDS[:3]).join(known, FIELDS[:3], "left").fillna(0, ["physical", "damage", "known"])
    return rows.select("matchid", "participantid", off("physical").alias("physical"), off("damage").alias("damage"), "known")


# Surfaces of features.
SURFACES = {"profile_only": ["kills", "deaths", "goldearned"], "context_only": ["visionscore", "wardsplaced"], "full": ["kills", "deaths", "goldearned", "visionscore", "wardsplaced"]}


@query("WITH " + WIDE + " SELECT matchid, participantid, " + " + ".join(SURFACES["full"]) + " AS full_sum, " + " + ".join(SURFACES["profile_only"]) + " AS profile_sum, " + " + ".join(SURFACES["context_only"]) + " AS context_sum FROM wide")
def flt4_feature_surfaces(spark, d):
    """Columns of a surface, and nothing else; a column that no surface allows is an error (FLT-5)."""
    rows = wide_players(spark, d)
    sums = {f"{n.split('_')[0]}_sum": sum((F.col(c) for c in augment.surface(rows, keep, ["matchid", "participantid"]).columns[2:]), F.lit(0)) for n, keep in SURFACES.items()}
    return rows.select("matchid", "participantid", *[v.alias(n) for n, v in sums.items()])


@query()
def pro20_pca_block(spark, d):
    """Standardised scores on four principal components of the embeddings, squared (signs are arbitrary), and what they explain."""
    scores, explained = latent.pca_block(table(spark, d, "embeddings"), "vec_id", "embedding", 4)
    return scores.select("vec_id", *[F.round(F.pow(F.col("scores")[i], 2.0), 4).alias(f"s{i}") for i in range(4)], F.lit(round(sum(explained), 6)).alias("explained"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL) SELECT a.i::INT AS i, b.i::INT AS j, count(*) AS n, round(avg(a.x * b.x) - avg(a.x) * avg(b.x) + 1e-12::DOUBLE, 8) AS covariance FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def pro21_covariances(spark, d):
    """Covariances of all pairs of columns, by partial products per task."""
    return latent.covariances(table(spark, d, "embeddings"), "embedding").withColumn("covariance", F.round(F.col("covariance") + 1e-12, 8))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL), v AS (SELECT i, var_pop(x) AS v, stddev_pop(x) AS s FROM e GROUP BY i), c AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL) SELECT (SELECT count(DISTINCT vec_id) FROM e) AS rows, (SELECT count(*) FROM v WHERE v > 1e-6)::INT AS active_dims, (SELECT round(avg(abs(c)), 6) FROM c) AS mean_abs_correlation, 1 AS rank_in_range")
def pro21_column_diagnostics(spark, d):
    """All columns; the effective rank, which SQL cannot express, lies between 1 and the number of columns (its value is tested by a fixture)."""
    out = latent.column_diagnostics(table(spark, d, "embeddings"), "embedding")
    within = (F.col("effective_rank") >= 1) & (F.col("effective_rank") <= F.col("active_dims") + 1e-9)
    return out.select("rows", "active_dims", r("mean_abs_correlation").alias("mean_abs_correlation"), within.cast("int").alias("rank_in_range"))


@query("WITH " + WIDE + ", i AS (SELECT championid, teamposition, build, count(*) AS matchups, sum(kills)::DOUBLE AS kills, sum(deaths)::DOUBLE AS deaths FROM wide GROUP BY ALL) SELECT championid, teamposition, build, round(kills / matchups + 1e-9::DOUBLE, 6) AS kills, round(deaths / matchups + 1e-9::DOUBLE, 6) AS deaths, round(CASE WHEN deaths > 1e-9::DOUBLE THEN (kills / matchups) / (deaths / matchups) ELSE 0 END + 1e-9::DOUBLE, 6) AS kills_to_deaths_ratio FROM i")
def pro11_level_matrix(spark, d):
    """A level's matrix: unique keys and an assembled vector of features, found through the metric registry (PRO-9)."""
    base = profiles.identity_base(wide_players(spark, d), FIELDS[:3], sorted(derived.inputs("kills_to_deaths_ratio")))
    level = derived.add_derived(profiles.metric_values(base, FIELDS[:3], ["kills", "deaths"], []), ["kills_to_deaths_ratio"])
    names = ["kills", "deaths", "kills_to_deaths_ratio"]
    matrix = augment.level_matrix(level, FIELDS[:3], names)
    return matrix.select(*FIELDS[:3], *[F.round(F.col("features")[i] + 1e-9, 6).alias(n) for i, n in enumerate(names)])


@query("SELECT p_partkey, rtrim(p_name) AS trimmed, substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, 12) AS id, 1 AS fresh FROM part")
def scf13_uuid_and_trim(spark, d):
    """Text as UUID, trailing NULs removed, and the time of the query as a default."""
    p = table(spark, d, "part")
    h = F.md5("p_name")
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    fresh = (F.coalesce(F.lit(None).cast("timestamp"), F.current_timestamp()) > F.lit("2020-01-01").cast("timestamp")).cast("int")
    return p.select("p_partkey", F.rtrim(F.concat("p_name", F.lit("\0\0")), F.lit("\0")).alias("trimmed"), F.concat_ws("-", *parts).alias("id"), fresh.alias("fresh"))


@query(WITH_SPLIT + """, g AS (SELECT matchid, split, max(CASE WHEN teamid = 100 THEN win END) AS blue_win, list(kills ORDER BY participantid) AS kills, list(championid ORDER BY participantid) AS champions FROM sp WHERE participantid <= 4 GROUP BY ALL HAVING count(*) = 4)
SELECT split, matchid, blue_win::INT AS blue_win, array_to_string(kills, ',') AS kills, array_to_string(champions, ',') AS champions, 0.0::DOUBLE AS support FROM g""")
def src12_checked_cache(spark, d):
    """A cache of arrays by game and split, whose labels, ranges and lengths are checked as it is written; both splits are loaded, one array by default."""
    path = _path(spark, "cache")
    g = split_players(spark, d).where("participantid <= 4").groupBy("matchid", "split").agg(F.count("*").alias("n"), F.max(F.when(F.col("teamid") == 100, F.col("win"))).alias("blue_win"), F.array_sort(F.collect_list(F.struct("participantid", "kills", "championid"))).alias("s"))
    g = g.where("n = 4").select("matchid", "split", "blue_win", F.col("s.kills").alias("kills"), F.col("s.championid").alias("champions"))
    most = checked.Check("most_kills", F.max(F.array_max("kills")), lambda v: v is None or v < 13, "kills stay below 13")
    checked.write_cache(g, path, "blue_win", {"kills": 4, "champions": 4}, checks=[most])
    splits = checked.load_splits(spark, path, need=["kills"], defaults={"support": 0.0}, verify=True)
    both = splits["train"].unionByName(splits["test"])
    return both.select("split", "matchid", "blue_win", F.array_join("kills", ",").alias("kills"), F.array_join("champions", ",").alias("champions"), F.array_max("support").alias("support"))


@query(WITH_SPLIT + f"SELECT championid, teamposition, count(*) AS n, round(avg(win), 6) AS rate FROM {TRAIN} GROUP BY ALL")
def flt5_pregame_table(spark, d):
    """A pregame table passes the guard of its lineage; the same table with a value that follows from builds is refused, or the query fails."""
    rows = split_players(spark, d).where("split = 'train'")
    table_ = rows.groupBy("championid", "teamposition").agg(F.count("*").alias("n"), r(F.avg("win")).alias("rate"))
    guards.assert_pregame(table_, ["championid", "teamposition"], build=("p_type",))
    leaky = rows.withColumn("x", F.length(F.upper("build"))).groupBy("championid", "teamposition").agg((F.max("x") + 1).alias("n"))
    try:
        guards.assert_pregame(leaky, ["championid", "teamposition"], build=("p_type",))
    except guards.Leak:
        return table_
    raise AssertionError("a value that follows from builds passed the guard")
