"""Registered queries of the library's operators over the test tables, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions import scalar as S
from matchforge.functions import smoothing as M
from matchforge.operators import bins, catalog, combos, correct, evaluate, filters, incremental, joins, labels, profiles, reports, windows
from matchforge.plans.adapters import EVENTS, PARTICIPANTS, SPLIT, match_events, match_split, participants, split_players, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WITH = "WITH " + PARTICIPANTS
WITH_SPLIT = WITH + SPLIT
TRAIN = "(SELECT * FROM sp WHERE split = 'train')"
FIELDS = ["championid", "teamposition", "build", "puuid"]
ROUND = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = ROUND):
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


def train(spark, d):
    return split_players(spark, d).where("split = 'train'")


# --- splits, solo priors and the flagship -------------------------------------------------------------------------


@query(WITH_SPLIT + "SELECT matchid, split FROM split")
def win5_chrono_split(spark, d):
    return match_split(spark, d)


SOLO = f"SELECT championid, teamposition, build, count(*) AS matchups, sum(win)::BIGINT AS wins, round(sum(win)::DOUBLE / count(*), 6) AS win_rate FROM {TRAIN} GROUP BY ALL"


@query(WITH_SPLIT + SOLO)
def cmb5_synergy_1vx(spark, d):
    return combos.solo(train(spark, d), FIELDS[:3]).withColumn("win_rate", r("win_rate"))


@query(
    WITH_SPLIT
    + f""", s AS (SELECT championid, teamposition, build, count(*) AS n, sum(win)::DOUBLE / count(*) AS rate FROM {TRAIN} GROUP BY ALL),
j AS (SELECT sp.*, coalesce(s.n, 0)::DOUBLE AS n, coalesce(s.rate, 0.5::DOUBLE) AS rate FROM sp LEFT JOIN s USING (championid, teamposition, build)),
l AS (SELECT *, CASE WHEN split = 'train' THEN greatest(n - 1, 0) ELSE n END AS n1,
        CASE WHEN split <> 'train' THEN rate WHEN n > 1 THEN (round(rate * n) - win) / (n - 1) ELSE 0.5::DOUBLE END AS r1 FROM j),
c AS (SELECT *, CASE WHEN n1 >= 50 THEN r1 ELSE 0.5::DOUBLE + (r1 - 0.5::DOUBLE) * n1 / (n1 + 20) END AS p FROM l)
SELECT matchid, teamid, round(avg(p), 6) AS prior, count(*) AS players FROM c GROUP BY ALL"""
)
def smo20_solo_prior_features(spark, d):
    rows = split_players(spark, d)
    solo = combos.solo(rows.where("split = 'train'"), FIELDS[:3]).select(*FIELDS[:3], F.col("matchups").cast("double").alias("n"), F.col("win_rate").alias("rate"))
    j = joins.lookup(rows, solo, FIELDS[:3], {"n": 0.0, "rate": 0.5})
    loo, rest = M.leave_one_out(F.col("rate"), F.col("n"), F.col("win"))
    is_train = F.col("split") == "train"
    j = j.withColumn("r1", F.when(is_train, loo).otherwise(F.col("rate"))).withColumn("n1", F.when(is_train, rest).otherwise(F.col("n")))
    j = j.withColumn("p", M.cascade_rate(F.col("r1"), F.col("n1"), 0.5, 20.0, 50.0))
    return j.groupBy("matchid", "teamid").agg(r(F.avg("p")).alias("prior"), F.count("*").alias("players"))


for _name, _keys in (("player_1vx", ["puuid"]), ("player_champ_1vx", ["puuid", "championid"]), ("player_role_1vx", ["puuid", "teamposition"])):

    def _solo(spark, d, keys=_keys):
        return combos.solo(train(spark, d), keys).withColumn("win_rate", r("win_rate"))

    QUERIES[f"cmb14_{_name}"] = _solo
    SQL[f"cmb14_{_name}"] = WITH_SPLIT + f"SELECT {', '.join(_keys)}, count(*) AS matchups, sum(win)::BIGINT AS wins, round(sum(win)::DOUBLE / count(*), 6) AS win_rate FROM {TRAIN} GROUP BY ALL"


# --- combinatorics: groups inside and across teams ----------------------------------------------------------------

KEY = "lpad(championid::VARCHAR, 4, '0') || ':' || teamposition || ':' || build"
FULL = (
    WITH_SPLIT
    + f""", full_games AS (SELECT matchid FROM {TRAIN} GROUP BY matchid HAVING count(*) = 10),
pl AS (SELECT matchid, teamid, win, {KEY} AS who, lpad(championid::VARCHAR, 4, '0') AS champ, lpad(championid::VARCHAR, 4, '0') || ':' || teamposition AS slot, role_index FROM sp SEMI JOIN full_games USING (matchid)),
"""
)


def games(spark, d):
    rows = train(spark, d)
    champ = F.lpad(F.col("championid").cast("string"), 4, "0")
    rows = rows.withColumn("slot", F.concat_ws(":", champ, "teamposition")).withColumn("who", F.concat_ws(":", champ, "teamposition", "build")).withColumn("champ", champ)
    return rows


def pivot(spark, d, field="who"):
    return combos.pivot_games(games(spark, d), [field])


def flat(df, *cols, field="who"):
    """Groups as text: members of a group joined in order."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda p: p[field]), "|") for c in cols}).withColumn("win_rate", r("win_rate"))


def members(k: int, field: str = "who") -> str:
    """SQL: all groups of k of each team, sorted, with the outcome."""
    tables = ", ".join(f"pl p{i}" for i in range(k))
    joined = " AND ".join([f"p{i}.matchid = p0.matchid AND p{i}.teamid = p0.teamid AND p{i}.role_index > p{i - 1}.role_index" for i in range(1, k)] or ["true"])
    return f"grp{k} AS (SELECT p0.matchid, p0.teamid, p0.win, array_to_string(list_sort([{', '.join(f'p{i}.{field}' for i in range(k))}]), '|') AS g FROM {tables} WHERE {joined})"


RATE = "count(*) AS matchups, sum(won)::BIGINT AS wins, round(sum(won)::DOUBLE / count(*), 6) AS win_rate"


def synergy_sql(k, field="who"):
    return FULL + members(k, field) + f" SELECT g AS members, {RATE} FROM (SELECT g, win AS won FROM grp{k}) GROUP BY g"


def versus_sql(a, b, field="who", canonical=True):
    two = members(a, field) + ("" if a == b else ", " + members(b, field))
    if a != b:
        pairs = f'SELECT x.g AS "left", y.g AS "right", x.win AS won FROM grp{a} x JOIN grp{b} y ON x.matchid = y.matchid AND x.teamid <> y.teamid'
    else:
        pairs = f"SELECT x.g AS l, y.g AS r, x.win AS w FROM grp{a} x JOIN grp{b} y ON x.matchid = y.matchid AND x.teamid = 100 AND y.teamid = 200"
        flip = "l <= r" if canonical else "true"
        pairs = f'SELECT CASE WHEN {flip} THEN l ELSE r END AS "left", CASE WHEN {flip} THEN r ELSE l END AS "right", CASE WHEN {flip} THEN w ELSE 1 - w END AS won FROM ({pairs})'
    return FULL + two + f' SELECT "left", "right", {RATE} FROM ({pairs}) GROUP BY ALL'


for _id, _a, _b, _field, _canonical in (("cmb1_matchup_1v1", 1, 1, "who", True), ("cmb2_matchup_2v2", 2, 2, "who", True), ("cmb3_matchup_2v1", 2, 1, "who", True), ("cmb4_matchup_3v1", 3, 1, "who", True), ("cmb9_matchup_1v1_nobuild", 1, 1, "slot", False), ("cmb10_matchup_1v1_champ", 1, 1, "champ", False)):

    def _versus(spark, d, a=_a, b=_b, field=_field, canonical=_canonical):
        return flat(combos.versus(pivot(spark, d, field), a, b, canonical), "left", "right", field=field)

    QUERIES[_id], SQL[_id] = _versus, versus_sql(_a, _b, _field, _canonical)

for _id, _k, _field in (("cmb6_synergy_2vx", 2, "who"), ("cmb7_synergy_3vx", 3, "who"), ("cmb8_synergy_4vx", 4, "who"), ("cmb11_synergy_2vx_nobuild", 2, "slot"), ("cmb12_synergy_2vx_champ", 2, "champ")):

    def _synergy(spark, d, k=_k, field=_field):
        return flat(combos.synergy(pivot(spark, d, field), k), "members", field=field)

    QUERIES[_id], SQL[_id] = _synergy, synergy_sql(_k, _field)


@query(FULL.replace(f"{KEY} AS who", "lpad(championid::VARCHAR, 4, '0') || ':' || teamposition || ':' || left(build, 1) AS who") + members(2) + f" SELECT g AS members, {RATE} FROM (SELECT g, win AS won FROM grp2) GROUP BY g")
def cmb13_synergy_2vx_build_group(spark, d):
    fine = combos.synergy(pivot(spark, d), 2)
    coarse = lambda p: F.struct(F.concat(F.substring_index(p["who"], ":", 2), F.lit(":"), F.substring(F.substring_index(p["who"], ":", -1), 1, 1)).alias("who"))
    return flat(combos.regroup(fine, coarse), "members")


@query(WITH_SPLIT + f""", g AS (SELECT matchid, teamid, string_agg(championid || ':' || build, ',' ORDER BY role_index) AS slots, count(*) AS n FROM {TRAIN} GROUP BY ALL)
SELECT matchid, teamid, slots FROM g WHERE matchid IN (SELECT matchid FROM g GROUP BY matchid HAVING sum(n) = 10)""")
def agg11_pivot_roles(spark, d):
    p = combos.pivot_games(train(spark, d), ["championid", "build"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["championid"], x["build"])), ",")
    return p.select("matchid", F.inline(F.array(F.struct(F.lit(100).alias("teamid"), text("blue").alias("slots")), F.struct(F.lit(200).alias("teamid"), text("red").alias("slots")))))


# --- joins --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, f.o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) f ON o_custkey = c_custkey AND i = 1")
def joi5_any_join(spark, d):
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return joins.any_join(table(spark, d, "customer").select("c_custkey"), first, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def joi3_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def joi4_anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


BINS = [(0.0, 10_000.0), (10_000.0, 50_000.0), (50_000.0, 150_000.0), (150_000.0, None)]


@query("SELECT bin, count(*) AS n, round(avg(o_totalprice), 4) AS centre FROM (SELECT CASE WHEN o_totalprice < 10000 THEN 0 WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 150000 THEN 2 ELSE 3 END AS bin, o_totalprice FROM orders) GROUP BY bin")
def joi7_scl2_bins(spark, d):
    return reports.bin_centres(table(spark, d, "orders"), "o_totalprice", BINS).withColumn("centre", r("centre", 4))


@query("""WITH b AS (SELECT i::INT AS bin, i * 50.0::DOUBLE AS low, CASE WHEN i < 9999 THEN (i + 1) * 50.0::DOUBLE END AS high FROM range(10000) t(i) UNION ALL SELECT (10000 + i)::INT, i * 1000.0::DOUBLE, i * 1000.0::DOUBLE + 3000 FROM range(500) t(i))
SELECT bin, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN b ON o_totalprice >= low AND (high IS NULL OR o_totalprice < high) GROUP BY bin""")
def joi7_many_bins(spark, d):
    """A table of 10,500 bins, some of which overlap, the last of the first kind open at its end."""
    one = spark.range(10_000).select(F.col("id").cast("int").alias("bin"), (F.col("id") * 50.0).alias("low"), F.when(F.col("id") < 9999, (F.col("id") + 1) * 50.0).alias("high"))
    two = spark.range(500).select((F.col("id") + 10_000).cast("int").alias("bin"), (F.col("id") * 1000.0).alias("low"), (F.col("id") * 1000.0 + 3000).alias("high"))
    held = bins.interval_join(table(spark, d, "orders"), one.unionByName(two), "o_totalprice")
    return held.groupBy("bin").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH m AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE / count(*) AS items, max(l_extendedprice)::DOUBLE / 1000 AS minutes FROM lineitem GROUP BY l_orderkey), b AS (SELECT * FROM (VALUES (1, 5.0, 15.0), (2, 15.0, 25.0), (3, 25.0, 35.0), (4, 35.0, NULL)) t(bin, low, high)),
a AS (SELECT bin, count(*) AS n, avg(minutes) AS mean FROM m JOIN b ON items >= low AND (high IS NULL OR items < high) GROUP BY bin), c AS (SELECT *, coalesce(lag(mean) OVER (ORDER BY bin), (SELECT min(minutes) FROM m)) AS f FROM a)
SELECT bin::INT AS bin, n, round(mean, 6) AS mean, round(f, 6) AS "from", round(mean, 6) AS "to", round((f + mean) / 2, 6) AS centroid FROM c""")
def scl2_chained_bins(spark, d):
    """Edges in minutes chained from the averages of bins of items."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity").cast("double") / F.count("*")).alias("items"), (F.max("l_extendedprice").cast("double") / 1000).alias("minutes"))
    held = bins.chained_bins(li, spark.createDataFrame([(1, 5.0, 15.0), (2, 15.0, 25.0), (3, 25.0, 35.0), (4, 35.0, None)], "bin int, low double, high double"), "items", "minutes")
    return held.select("bin", "n", *[r(c).alias(c) for c in ("mean", "from", "to", "centroid")])


@query("""WITH c AS (SELECT DISTINCT s_acctbal::DOUBLE * 20 AS c FROM supplier), e AS (SELECT min(c) AS a, max(c) AS z FROM c)
SELECT o_orderkey, coalesce(l.c, a) AS low, coalesce(h.c, z) AS high FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS v FROM orders) o ASOF LEFT JOIN c l ON o.v >= l.c ASOF LEFT JOIN c h ON o.v <= h.c, e""")
def joi8_nearest_centres(spark, d):
    """The centres around each price; the centres come from another table."""
    centres = table(spark, d, "supplier").select((F.col("s_acctbal").cast("double") * 20).alias("centre"))
    return bins.nearest_centres(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), centres, "o_totalprice").select("o_orderkey", "low", "high")


CENTRES = [5_000.0, 30_000.0, 100_000.0, 200_000.0]


@query("""WITH c AS (SELECT unnest([5000.0, 30000.0, 100000.0, 200000.0])::DOUBLE AS c)
SELECT o_orderkey, coalesce(max(CASE WHEN c <= o_totalprice THEN c END), 5000.0)::DOUBLE AS low, coalesce(min(CASE WHEN c >= o_totalprice THEN c END), 200000.0)::DOUBLE AS high FROM orders, c GROUP BY o_orderkey""")
def joi8_bracket_bins(spark, d):
    return joins.bracket(table(spark, d, "orders"), CENTRES, "o_totalprice").select("o_orderkey", "low", "high")


@query("""WITH c AS (SELECT unnest([5000.0, 30000.0, 100000.0, 200000.0])::DOUBLE AS c),
b AS (SELECT o_orderkey, o_totalprice AS v, coalesce(max(CASE WHEN c <= o_totalprice THEN c END), 5000.0)::DOUBLE AS low, coalesce(min(CASE WHEN c >= o_totalprice THEN c END), 200000.0)::DOUBLE AS high FROM orders, c GROUP BY ALL),
w AS (SELECT *, greatest((high - low) / 3, 0.25::DOUBLE) AS s FROM b),
p AS (SELECT *, 1 / (1 + exp(least(greatest(0.5::DOUBLE * (pow((v - low) / s, 2) - pow((v - high) / s, 2)), -700), 700))) AS p FROM w)
SELECT o_orderkey, round(p, 6) AS p_low, CASE WHEN (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000) / 10000.0::DOUBLE < p THEN low ELSE high END AS centre FROM p""")
def scl3_soft_bins(spark, d):
    return reports.soft_bins(table(spark, d, "orders"), "o_orderkey", "o_totalprice", CENTRES).select("o_orderkey", r("p_low").alias("p_low"), "centre")


HOURS15 = 15 * 3_600_000


@query("WITH " + EVENTS + f""", e AS (SELECT matchid, max("timestamp") AS end_at FROM ev GROUP BY matchid)
SELECT event_id, matchid, end_at - "timestamp" AS before_end FROM ev JOIN e USING (matchid) WHERE "timestamp" >= end_at - {HOURS15}""")
def joi9_tail_window(spark, d):
    ev = match_events(spark, d)
    return joins.tail_window(ev, correct.match_ends(ev), "matchid", "timestamp", "end_at", HOURS15).select("event_id", "matchid", (F.col("end_at") - F.col("timestamp")).alias("before_end"))


@query("""WITH w AS (SELECT p_brand, p_type, p_size, max(p_retailprice) AS v FROM part WHERE p_size % 3 = 0 GROUP BY ALL), c AS (SELECT p_size, min(p_retailprice) AS v FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
SELECT p_partkey, round(coalesce(CASE WHEN w.p_brand IS NOT NULL THEN w.v ELSE c.v END, 0::DOUBLE), 4) AS v FROM part LEFT JOIN w USING (p_brand, p_type, p_size) LEFT JOIN c USING (p_size)""")
def joi11_lookup_with_fallback(spark, d):
    p = table(spark, d, "part")
    fine = p.where("p_size % 3 = 0").groupBy("p_brand", "p_type", "p_size").agg(F.max("p_retailprice").alias("v"))
    coarse = p.where("p_size % 2 = 0").groupBy("p_size").agg(F.min("p_retailprice").alias("v"))
    return joins.lookup_with_fallback(p.select("p_partkey", "p_brand", "p_type", "p_size"), fine, coarse, ["p_brand", "p_type", "p_size"], ["p_size"], ["v"]).select("p_partkey", r("v", 4).alias("v"))


# --- windows, order, sets -----------------------------------------------------------------------------------------


@query(WITH + "SELECT puuid, matchid, participantid, count(*) OVER w AS suffix_games, sum(win) OVER w AS suffix_wins FROM players WINDOW w AS (PARTITION BY puuid ORDER BY started DESC, matchid DESC, participantid ROWS UNBOUNDED PRECEDING)")
def win3_suffix_rate(spark, d):
    return windows.suffix_rate(participants(spark, d), ["puuid"], [F.desc("started"), F.desc("matchid"), "participantid"], "win").select("puuid", "matchid", "participantid", "suffix_games", "suffix_wins")


HASH = "('0x' || substr(md5('x' || o_orderkey::VARCHAR), 1, 8))::BIGINT"


@query(f"""WITH l AS (SELECT o_orderpriority AS g, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASH}, o_orderkey) AS turn FROM orders)
SELECT g, o_orderkey, turn FROM l WHERE turn <= 40 ORDER BY turn, g LIMIT 120""")
def str4_claim_batch(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey")
    return incremental.claim(q, "g", "o_orderkey", 40, 120, "x").select("g", "o_orderkey", "turn")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 3")
def srt3_limit_by(spark, d):
    return windows.limit_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS matchid FROM lineitem), done AS (SELECT o_orderkey AS matchid FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT matchid FROM n), q AS (SELECT o_orderkey AS matchid FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey AS matchid FROM orders WHERE o_orderkey NOT IN (SELECT matchid FROM done) AND o_orderkey NOT IN (SELECT matchid FROM q)""")
def str3_seed_queue(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("matchid"), "o_orderstatus")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("matchid"))
    return incremental.seed_queue(o, [o.where("o_orderstatus = 'F'"), lines], o.where("o_orderstatus = 'P'"))


@query("""WITH i AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), t AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'R'), m AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 50000), v AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority < '3')
SELECT o_orderkey AS matchid, CASE WHEN i.k IS NOT NULL AND t.k IS NOT NULL AND m.k IS NOT NULL THEN 'complete' WHEN (i.k IS NULL) <> (t.k IS NULL) THEN 'stream_partial' WHEN i.k IS NOT NULL AND t.k IS NOT NULL AND v.k IS NOT NULL THEN 'metadata_only' ELSE 'blocked' END AS gap
FROM orders LEFT JOIN i ON i.k = o_orderkey LEFT JOIN t ON t.k = o_orderkey LEFT JOIN m ON m.k = o_orderkey LEFT JOIN v ON v.k = o_orderkey""")
def set3_classify_gaps(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "matchid")
    t = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("matchid"))
    return incremental.classify_gaps(o, o.where("o_orderstatus <> 'P'"), t, o.where("o_totalprice > 50000"), o.where("o_orderpriority < '3'"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(a.k, b.k) AS k, (a.k IS NOT NULL)::INT AS in_a, (b.k IS NOT NULL)::INT AS in_b, ((a.k IS NULL) <> (b.k IS NULL))::INT AS partial FROM a FULL JOIN b ON a.k = b.k""")
def set2_presence(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return incremental.presence(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("SELECT o_custkey AS run_id FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_custkey DESC) AS i FROM orders WHERE o_orderpriority = '1-URGENT') WHERE i = 1")
def str1_latest_run(spark, d):
    return incremental.latest_run(table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("stored_at")), "1-URGENT")


@query("SELECT o_custkey AS puuid, least(greatest(max(o_orderdate), TIMESTAMP '1996-01-01'), TIMESTAMP '1998-01-01') AS since FROM orders GROUP BY o_custkey")
def str8_crawl_windows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("puuid"), F.col("o_orderdate").alias("collected_at"))
    import datetime

    out = incremental.crawl_windows(o, o, datetime.datetime(1996, 1, 1), datetime.datetime(1998, 1, 1))
    return out.withColumn("since", F.col("since").cast("timestamp_ntz")) if dict(o.dtypes)["collected_at"] == "timestamp_ntz" else out


@query("WITH o AS (SELECT l_orderkey AS matchid, CASE WHEN l_returnflag = 'N' THEN 'success' WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber > 4 THEN 'terminal' ELSE 'other' END AS outcome FROM lineitem) SELECT matchid, CASE WHEN max((outcome = 'terminal')::INT) = 1 THEN 'retire' WHEN sum((outcome = 'success')::INT) >= 2 THEN 'finish' ELSE 'requeue' END AS action FROM o GROUP BY matchid")
def str5_resolve_batch(spark, d):
    o = F.when(F.col("l_returnflag") == "N", "success").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 4), "terminal").otherwise("other")
    return incremental.resolve_batch(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("matchid"), o.alias("outcome")))


@query("""WITH rules AS (SELECT * FROM (VALUES (1, NULL, NULL, 1), (2, 'O', NULL, 5), (3, NULL, '1-URGENT', 9), (4, 'O', '1-URGENT', 0), (5, 'F', NULL, 5), (6, 'F', NULL, 7)) t(rule_id, o_orderstatus, o_orderpriority, priority)),
t AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderstatus, o_orderpriority, rule_id FROM (SELECT t.*, rule_id, row_number() OVER (PARTITION BY t.o_orderstatus, t.o_orderpriority ORDER BY (r.o_orderstatus IS NOT NULL)::INT + (r.o_orderpriority IS NOT NULL)::INT DESC, priority DESC, rule_id) AS i
FROM t JOIN rules r ON (r.o_orderstatus IS NULL OR r.o_orderstatus = t.o_orderstatus) AND (r.o_orderpriority IS NULL OR r.o_orderpriority = t.o_orderpriority)) WHERE i = 1""")
def win7_resolve_rules(spark, d):
    rules = spark.createDataFrame([(1, None, None, 1), (2, "O", None, 5), (3, None, "1-URGENT", 9), (4, "O", "1-URGENT", 0), (5, "F", None, 5), (6, "F", None, 7)], "rule_id int, o_orderstatus string, o_orderpriority string, priority int")
    return windows.resolve_rules(rules, table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct(), ["o_orderstatus", "o_orderpriority"])


# --- filters ------------------------------------------------------------------------------------------------------

TEAMS = """, sums AS (SELECT matchid, teamid, sum(kills) AS k, sum(deaths) AS dd, sum(damage) AS dm, coalesce(avg(CASE WHEN teamposition <> 'UTILITY' AND timeplayed > 0 THEN (totalminionskilled + neutralminionskilled) * 60.0::DOUBLE / timeplayed END), 0::DOUBLE) AS cs FROM players GROUP BY ALL),
both_teams AS (SELECT DISTINCT matchid, t AS teamid FROM players, (SELECT unnest([100, 200]) AS t)),
teams AS (SELECT b.matchid, b.teamid, coalesce(o.k, 0) AS team_kills, coalesce(o.dd, 0) AS team_deaths, coalesce(o.dm, 0) AS team_damage, coalesce(e.dm, 0) AS enemy_damage, coalesce(o.cs, 0::DOUBLE) AS team_cs, coalesce(e.cs, 0::DOUBLE) AS enemy_cs
  FROM both_teams b LEFT JOIN sums o USING (matchid, teamid) LEFT JOIN sums e ON e.matchid = b.matchid AND e.teamid = 300 - b.teamid)"""
FLAGS = (
    WITH
    + TEAMS
    + """, flags AS (SELECT matchid, participantid, ((kills + assists) * 10 < deaths * 2)::INT AS low_kda, (win = 0 AND goldearned > 0 AND goldspent * 100 < goldearned * 50)::INT AS gold_spent,
  (win = 1 AND team_kills > 0 AND kills * 100 > team_kills * 75)::INT AS solo_carried, (teamposition <> 'UTILITY' AND team_damage > 0 AND damage * 50 < team_damage)::INT AS too_little_damage,
  (teamposition <> 'UTILITY' AND timeplayed > 0 AND (totalminionskilled + neutralminionskilled) * 60 < timeplayed * 3)::INT AS low_minions, (win = 0 AND spellcasts = 0)::INT AS zero_spell_casts_loss, (win = 0 AND itemspurchased = 0)::INT AS zero_item_purchases_loss,
  (team_kills * 5 < team_deaths * 2)::INT AS team_kd, (enemy_cs - team_cs > 2)::INT AS team_cs_gap, (enemy_damage > 0 AND team_damage * 2 < enemy_damage)::INT AS team_damage_ratio FROM players JOIN teams USING (matchid, teamid))"""
)
ABSENT = ("high_winrate", "low_build_value", "game_ruining", *filters.BEHAVIOUR)
USED = ["low_kda", "gold_spent", "solo_carried", "too_little_damage", "low_minions", "zero_spell_casts_loss", "zero_item_purchases_loss", "team_kd", "team_cs_gap", "team_damage_ratio"]


@query(WITH + TEAMS + " SELECT matchid, teamid, team_kills::BIGINT AS team_kills, team_deaths::BIGINT AS team_deaths, team_damage::BIGINT AS team_damage, enemy_damage::BIGINT AS enemy_damage, round(team_cs, 6) AS team_cs, round(enemy_cs, 6) AS enemy_cs FROM teams")
def tea1_team_totals(spark, d):
    return filters.team_totals(participants(spark, d)).withColumn("team_cs", r("team_cs")).withColumn("enemy_cs", r("enemy_cs"))


@query(FLAGS + f" SELECT matchid, participantid, {', '.join(USED)} FROM flags")
def rul_a_participant_flags(spark, d):
    return filters.participant_flags(participants(spark, d), ABSENT).select("matchid", "participantid", *USED)


def mask_sql(names, agg="{}"):
    return " + ".join(f"{agg.format(n)}::BIGINT * {1 << filters.BITS[n]}" for n in names)


@query(FLAGS + f""", g AS (SELECT matchid, {mask_sql(USED, 'max({})')} AS rule_mask FROM flags GROUP BY matchid)
SELECT matchid, participantid, {mask_sql([u for u in USED if u not in filters.TEAM])} AS player_rule_mask, {mask_sql(filters.TEAM)} AS team_rule_mask, rule_mask, (rule_mask = 0)::INT AS is_valid FROM flags JOIN g USING (matchid)""")
def rul_d_filter_result(spark, d):
    return filters.filter_result(filters.participant_flags(participants(spark, d), ABSENT))


@query(FLAGS + f" SELECT matchid FROM flags GROUP BY matchid HAVING {' + '.join(f'max({u})' for u in USED)} = 0")
def rul_b_clean_matches(spark, d):
    return filters.clean_matches(filters.participant_flags(participants(spark, d), ABSENT))


@query(FLAGS + f""", g AS (SELECT matchid, {', '.join(f'max({u}) AS {u}' for u in USED)}, greatest({', '.join(f'max({u})' for u in USED)}) AS a FROM flags GROUP BY matchid), cnt AS (SELECT count(*) AS n_games FROM g),
rows_ AS ({' UNION ALL '.join(f"SELECT '{b}' AS rule, " + (f'sum({b})' if b in USED else 'sum(0)') + '::BIGINT AS games FROM g' for b in filters.BITS)} UNION ALL SELECT 'any', sum(a)::BIGINT FROM g UNION ALL SELECT 'valid', (count(*) - sum(a))::BIGINT FROM g)
SELECT rule, games, round(games::DOUBLE / n_games, 6) AS share FROM rows_, cnt""")
def rep4_filter_statistics(spark, d):
    return filters.filter_statistics(filters.participant_flags(participants(spark, d), ABSENT))


@query(WITH + """, life AS (SELECT puuid FROM players GROUP BY puuid HAVING count(*) > 20 AND sum(win) * 100 > count(*) * 50),
run AS (SELECT puuid, matchid, participantid, count(*) OVER w AS g, sum(win) OVER w AS s FROM players SEMI JOIN life USING (puuid) WINDOW w AS (PARTITION BY puuid ORDER BY started DESC, matchid DESC, participantid ROWS UNBOUNDED PRECEDING))
SELECT puuid, matchid, max((s * 100 >= g * 85)::INT) AS high_winrate FROM run GROUP BY ALL""")
def rul03_high_winrate(spark, d):
    out = filters.high_winrate(participants(spark, d), [F.desc("started"), F.desc("matchid"), "participantid"], 20, 50, 85)
    return out.groupBy("puuid", "matchid").agg(F.max("high_winrate").alias("high_winrate"))


@query("WITH i AS (SELECT o_orderkey, year(o_orderdate) AS season, o_totalprice FROM orders) SELECT o_orderkey FROM i WHERE season = (SELECT max(season) FROM i) AND o_totalprice > 990")
def flt1_base_population(spark, d):
    info = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("gameduration"))
    return filters.base_population(info).select("o_orderkey")


# --- correction ---------------------------------------------------------------------------------------------------


@query("WITH " + EVENTS + f""", e AS (SELECT matchid, max("timestamp") AS end_at FROM ev GROUP BY matchid), t AS (SELECT ev.* FROM ev JOIN e USING (matchid) WHERE "timestamp" >= end_at - {HOURS15 * 10}),
s AS (SELECT matchid, participantid, count(*)::DOUBLE AS kills, sum(value) AS goldspent FROM ev GROUP BY ALL),
dl AS (SELECT matchid, participantid, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS kills, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS goldspent FROM t GROUP BY ALL)
SELECT matchid, participantid, greatest(s.kills - coalesce(dl.kills, 0), 0)::DOUBLE AS kills, round(greatest(s.goldspent - coalesce(dl.goldspent, 0), 0), 4) AS goldspent FROM s LEFT JOIN dl USING (matchid, participantid)""")
def cor6_apply_deltas(spark, d):
    ev = match_events(spark, d)
    tail = correct.padding(ev, correct.match_ends(ev), ["event_id"], HOURS15 * 10)
    keys = ["matchid", "participantid"]
    parts = [tail.where("event_type = 'click'").select(*keys, F.lit(1.0).alias("kills")), tail.where("event_type = 'purchase'").select(*keys, F.col("value").alias("goldspent"))]
    stats = ev.groupBy(*keys).agg(F.count("*").cast("double").alias("kills"), F.sum("value").alias("goldspent"))
    return correct.apply_deltas(stats, correct.delta_totals(parts, keys), keys).withColumn("goldspent", r("goldspent", 4))


# --- labels, reports, catalogue -----------------------------------------------------------------------------------


@query(WITH + """, n AS (SELECT championid, teamposition, build, count(*) AS n FROM players GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY championid, teamposition)::BIGINT AS slot_n FROM n)
SELECT championid, teamposition, build, n, slot_n, round(n::DOUBLE / slot_n, 6) AS share FROM s WHERE n > 5""")
def rep1_label_distribution(spark, d):
    return reports.label_distribution(participants(spark, d), "build", 5)


ITEMS = ", it AS (SELECT matchid, participantid, championid, teamposition, unnest([championid % 7, championid % 5, championid % 3]) AS itemid FROM players)"


def _items(spark, d, extra=()):
    p = participants(spark, d).withColumns({"item0": F.col("championid") % 7, "item1": F.col("championid") % 5, "item2": F.col("championid") % 3})
    return labels.explode_items(p, ["matchid", "participantid", "championid", "teamposition", *extra], ["item0", "item1", "item2"])


@query(WITH + ITEMS + "SELECT championid, teamposition, itemid, count(*) AS uses FROM it WHERE itemid <> 0 GROUP BY ALL")
def rep3_item_frequency(spark, d):
    return reports.item_frequency(_items(spark, d))


WEIGHTS = [(1, 0.5, 0.0, 0.25), (2, 0.0, 0.5, 0.5), (3, 0.25, 0.25, 0.0), (4, 1.0, 0.0, 0.75), (6, 0.0, 0.125, 0.5)]


@query(WITH + ITEMS + f""", w(itemid, crit, lethality, on_hit) AS (VALUES {', '.join(map(str, WEIGHTS))}),
kept AS (SELECT * FROM it WHERE itemid <> 0 UNION ALL SELECT matchid, participantid, championid, teamposition, 0 FROM it GROUP BY ALL HAVING max(itemid) = 0),
t AS (SELECT matchid, participantid, sum(CASE WHEN championid = 9 THEN 1.0 ELSE coalesce(crit, 0) END)::DOUBLE AS crit, sum(CASE WHEN championid = 9 THEN 0 ELSE coalesce(lethality, 0) END)::DOUBLE AS lethality, sum(CASE WHEN championid = 9 THEN 0 ELSE coalesce(on_hit, 0) END)::DOUBLE AS on_hit FROM kept LEFT JOIN w USING (itemid) GROUP BY ALL)
SELECT matchid, participantid, round(greatest(crit, lethality, on_hit), 6) AS best, CASE WHEN greatest(crit, lethality, on_hit) = 0 THEN 'none' WHEN crit = greatest(crit, lethality, on_hit) THEN 'crit' WHEN lethality = greatest(crit, lethality, on_hit) THEN 'lethality' ELSE 'on_hit' END AS label FROM t""")
def lab3_archetype_label(spark, d):
    names = ["crit", "lethality", "on_hit"]
    coarse = spark.createDataFrame(WEIGHTS, "itemid int, crit double, lethality double, on_hit double")
    fine = spark.range(0, 7).select(F.lit(9).alias("championid"), F.col("id").cast("int").alias("itemid"), F.lit(1.0).alias("crit"), F.lit(0.0).alias("lethality"), F.lit(0.0).alias("on_hit"))
    totals = labels.archetype_totals(_items(spark, d), fine, coarse, ["matchid", "participantid"], ["championid", "itemid"], names)
    return labels.argmax_label(totals, names).select("matchid", "participantid", r("best").alias("best"), "label")


CATALOG = (
    WITH_SPLIT
    + f""", n AS (SELECT championid, teamposition, build, count(*) AS n FROM {TRAIN} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY championid, teamposition) AS total FROM n),
role0 AS (SELECT teamposition, build, sum(n) AS rn FROM n GROUP BY ALL), role AS (SELECT teamposition, build, rn / sum(rn) OVER (PARTITION BY teamposition) AS q FROM role0),
k AS (SELECT t.*, q, sum(n) OVER w AS kept_n, sum(q) OVER w AS mass FROM t JOIN role USING (teamposition, build) WHERE n >= 2 AND n / total >= 0.05 WINDOW w AS (PARTITION BY championid, teamposition)),
cat AS (SELECT championid, teamposition, build, n, n / total AS share, kept_n / total AS retained_mass, (n + 20 * q / mass) / (kept_n + 20) AS p, CASE WHEN n >= 5 AND n / total >= 0.1 THEN 'core' ELSE 'tail' END AS tier FROM k)"""
)


def _catalog(spark, d):
    counts = train(spark, d).groupBy("championid", "teamposition", "build").agg(F.count("*").alias("n"))
    return catalog.build_catalog(counts, 2, 0.05, 20.0, 5, 0.1)


@query(CATALOG + " SELECT championid, teamposition, build, n, round(share, 6) AS share, round(retained_mass, 6) AS retained_mass, round(p, 6) AS p, tier FROM cat")
def cat1_build_catalog(spark, d):
    return _catalog(spark, d).withColumns({c: r(c) for c in ("share", "retained_mass", "p")})


@query(CATALOG + " SELECT championid, teamposition, build AS modal_build FROM (SELECT *, row_number() OVER (PARTITION BY championid, teamposition ORDER BY round(p, 9) DESC, build) AS i FROM cat) WHERE i = 1")
def srt6_modal_build(spark, d):
    return catalog.modal_build(_catalog(spark, d).withColumn("p", r("p", 9))).select("championid", "teamposition", "modal_build")


@query(CATALOG + ", s AS (SELECT championid, teamposition, sum(n) AS sn FROM cat GROUP BY ALL), h AS (SELECT *, sn / sum(sn) OVER (PARTITION BY championid) AS rs FROM s) SELECT championid, teamposition, build, round(p * rs, 6) AS weight FROM cat JOIN h USING (championid, teamposition) WHERE tier = 'core'")
def cat7_eligibility_pool(spark, d):
    return catalog.eligibility_pool(_catalog(spark, d)).withColumn("weight", r("weight"))


#: Slots of a game are its lines, all of them. A line's choices are its part with its supplier and the two next suppliers.
WORLDS = """WITH RECURSIVE sl AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS s, l_partkey AS pk, l_suppkey AS sk, l_quantity::DOUBLE AS q FROM lineitem),
ch AS (SELECT g, s, pk || '-' || sk AS build, (50 + q) / 110 AS p FROM sl UNION ALL SELECT g, s, pk || '-' || (sk + 1), (60 - q) / 110 * 0.7::DOUBLE FROM sl UNION ALL SELECT g, s, pk || '-' || (sk + 2), (60 - q) / 110 * 0.3::DOUBLE FROM sl),
w AS (SELECT g, 1 AS s, [build] AS builds, p AS wt FROM ch WHERE s = 1
  UNION ALL SELECT g, s, builds, wt FROM (SELECT w.g, ch.s, list_append(w.builds, ch.build) AS builds, w.wt * ch.p AS wt, row_number() OVER (PARTITION BY w.g ORDER BY w.wt * ch.p DESC, list_append(w.builds, ch.build)) AS i FROM w JOIN ch ON ch.g = w.g AND ch.s = w.s + 1) WHERE i <= 512),
n AS (SELECT g, max(s) AS slots FROM sl GROUP BY g), o AS (SELECT w.g, wt AS w, row_number() OVER (PARTITION BY w.g ORDER BY wt DESC, builds) AS world FROM w JOIN n ON n.g = w.g AND n.slots = w.s),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY g ORDER BY world ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
"""


def _slots(spark, d):
    """The lines of every order as slots. A game gathers plain values; choices are made from these afterwards."""
    li = table(spark, d, "lineitem")
    plain = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    games = li.select(F.col("l_orderkey").alias("g"), plain.alias("x")).groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("lines"))

    def choices(x):
        q = x["l_quantity"].cast("double")
        choice = lambda step, p: F.struct(F.concat_ws("-", x["l_partkey"], x["l_suppkey"] + step).alias("build"), p.alias("p"))
        return F.array(choice(0, (50 + q) / 110.0), choice(1, (60 - q) / 110.0 * 0.7), choice(2, (60 - q) / 110.0 * 0.3))

    return games.select("g", F.transform("lines", choices).alias("slots"))


def _worlds(spark, d):
    return catalog.joint_worlds(_slots(spark, d), "slots", 3, 512, 0.9)


@query(WORLDS + "SELECT g, count(*) AS worlds, round(sum(w), 6) AS mass FROM c WHERE before < 0.9 GROUP BY g")
def cat4_joint_worlds(spark, d):
    worlds = catalog.game_worlds(_slots(spark, d), "slots", 3, 512, 0.9)
    return worlds.select("g", F.size("weights").cast("long").alias("worlds"), r(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)).alias("mass"))


@query(WORLDS + "SELECT g, round(sum(w * (g % 10) / 10.0::DOUBLE) / sum(w), 6) AS score, round(sum(w), 6) AS retained_mass, count(*) AS worlds, (sum(w) < 0.02)::INT AS low_confidence FROM c WHERE before < 0.9 GROUP BY g")
def cat5_marginal_score(spark, d):
    out = catalog.marginalise(_worlds(spark, d).withColumn("score", (F.col("g") % 10) / 10.0), "g", floor=0.02)
    return out.withColumn("score", r("score")).withColumn("retained_mass", r("retained_mass"))


# --- smoothing ----------------------------------------------------------------------------------------------------


@query(WITH_SPLIT + f""", c3 AS (SELECT championid, teamposition, build, count(*)::DOUBLE AS n3, avg(win) AS r3 FROM {TRAIN} GROUP BY ALL), c2 AS (SELECT championid, teamposition, count(*)::DOUBLE AS n2, avg(win) AS r2 FROM {TRAIN} GROUP BY ALL), c1 AS (SELECT championid, count(*)::DOUBLE AS n1, avg(win) AS r1 FROM {TRAIN} GROUP BY ALL),
a AS (SELECT *, 0.5::DOUBLE + (r1 - 0.5) * n1 / (n1 + 20) AS v1, n1 AS e1 FROM c3 JOIN c2 USING (championid, teamposition) JOIN c1 USING (championid)),
b AS (SELECT *, v1 + (r2 - v1) * n2 / (n2 + 20) AS v2, n2 + (1 - n2 / (n2 + 20)) * e1 AS e2 FROM a)
SELECT championid, teamposition, build, round(v2 + (r3 - v2) * n3 / (n3 + 20), 6) AS rate, round(n3 + (1 - n3 / (n3 + 20)) * e2, 6) AS effective_n FROM b""")
def smo12_nested_shrink(spark, d):
    t = train(spark, d)
    level = lambda keys, i: t.groupBy(*keys).agg(F.count("*").cast("double").alias(f"n{i}"), F.avg("win").alias(f"r{i}"))
    j = level(FIELDS[:3], 3).join(level(FIELDS[:2], 2), FIELDS[:2]).join(level(FIELDS[:1], 1), FIELDS[:1])
    rate, n = M.nested_shrink([(F.col(f"r{i}"), F.col(f"n{i}")) for i in (1, 2, 3)], 0.5, 20.0)
    return j.select(*FIELDS[:3], r(rate).alias("rate"), r(n).alias("effective_n"))


@query(WITH_SPLIT + f""", c AS (SELECT teamposition, championid, count(*)::DOUBLE AS n, avg(win) AS r FROM {TRAIN} GROUP BY ALL), m AS (SELECT teamposition, sum(r * n) / sum(n) AS mu, sum(r * r * n) / sum(n) AS r2, sum(r * (1 - r)) / sum(n) AS within FROM c GROUP BY teamposition)
SELECT teamposition, round(mu, 6) AS mu, round(CASE WHEN r2 - mu * mu - within > 1e-12 THEN least(greatest(mu * (1 - mu) / (r2 - mu * mu - within) - 1, 1), 10000) ELSE 20 END, 4) AS strength FROM m""")
def smo11_strength_from_cells(spark, d):
    cells = train(spark, d).groupBy("teamposition", "championid").agg(F.count("*").alias("n"), F.avg("win").alias("rate"))
    m = M.eb_moments(cells, "rate", "n", ["teamposition"])
    return m.select("teamposition", r("mu").alias("mu"), r(M.strength_from_moments(F.col("mu"), F.col("total"), F.col("within")), 4).alias("strength"))


@query(WITH_SPLIT + f""", g AS (SELECT season, patch, matchid, max(CASE WHEN teamid = 100 THEN win END)::INT AS w, any_value(split) AS split FROM sp GROUP BY ALL), c AS (SELECT season, patch, sum(w)::DOUBLE AS wins, count(*)::DOUBLE AS n FROM g WHERE split = 'train' GROUP BY ALL)
SELECT season, patch, round(CASE WHEN n >= 20 THEN ln(least(greatest(wins / n, 1e-6), 1 - 1e-6) / (1 - least(greatest(wins / n, 1e-6), 1 - 1e-6))) * n / (n + 30) ELSE 0 END, 6) AS delta FROM c""")
def smo23_patch_delta(spark, d):
    g = train(spark, d).groupBy("season", "patch", "matchid").agg(F.max(F.when(F.col("teamid") == 100, F.col("win"))).alias("w"))
    c = g.groupBy("season", "patch").agg(F.sum("w").cast("double").alias("wins"), F.count("*").cast("double").alias("n"))
    return c.select("season", "patch", r(M.patch_delta(F.col("wins"), F.col("n"), least=20)).alias("delta"))


@query(WITH_SPLIT + f""", n AS (SELECT championid, count(*) AS n FROM {TRAIN} GROUP BY ALL) SELECT championid, round(ln(1 + n) / avg(ln(1 + n)) OVER (), 6) AS weight FROM n""")
def smo27_support_weights(spark, d):
    n = train(spark, d).groupBy("championid").agg(F.count("*").alias("n"))
    mean = n.agg(F.avg(F.log1p("n")).alias("m"))
    return n.crossJoin(mean).select("championid", r(F.log1p("n") / F.col("m")).alias("weight"))


# --- profiles -----------------------------------------------------------------------------------------------------

STATS = ["kills", "deaths", "assists", "goldearned", "damage"]


@query(WITH + f"SELECT championid, teamposition, build, count(*) AS matchups, round(sum(timeplayed) / count(*), 6) AS time, {', '.join(f'round(sum({s}) / count(*), 6) AS {s}' for s in STATS)}, round(60 * sum(damage) / sum(timeplayed), 6) AS damage_per_min FROM players GROUP BY ALL")
def pro1_identity_base(spark, d):
    base = profiles.identity_base(participants(spark, d), FIELDS[:3], STATS)
    level = base.withColumn("time", F.col("timeplayed_sum"))
    out = profiles.metric_values(level, FIELDS[:3], ["time", *STATS], ["damage"])
    return out.withColumns({c: r(c) for c in ["time", *STATS, "damage_per_min"]})


@query(WITH + f"SELECT teamposition, build, count(*) AS matchups, sum(timeplayed)::BIGINT AS timeplayed_sum, {', '.join(f'sum({s})::DOUBLE AS {s}' for s in STATS)} FROM players GROUP BY ALL")
def agg9_rollup_level(spark, d):
    return profiles.rollup_level(profiles.identity_base(participants(spark, d), FIELDS[:3], STATS), ["teamposition", "build"], STATS)


@query(WITH + "SELECT matchid, participantid, round(kills / greatest(sum(kills) OVER w, 1), 6) AS kills_share, round(CASE WHEN sum(kills) OVER w > 0 THEN sum(kills * kills) OVER w / pow(sum(kills) OVER w, 2) ELSE 0 END, 6) AS kills_concentration FROM players WINDOW w AS (PARTITION BY matchid, teamid)")
def pro3_team_shares(spark, d):
    return profiles.team_shares(participants(spark, d), ["kills"]).select("matchid", "participantid", r("kills_share").alias("kills_share"), r("kills_concentration").alias("kills_concentration"))


@query(WITH + """, o AS (SELECT matchid, participantid, damage::DOUBLE AS a, sum(damage) OVER w - damage AS b, count(*) OVER w AS n FROM players WINDOW w AS (PARTITION BY matchid, teamposition))
SELECT matchid, participantid, (a - b)::DOUBLE AS damage_diff, round((a - b) / greatest(abs(a) + abs(b), 1), 6) AS damage_advantage FROM o WHERE n = 2""")
def pro4_role_opponent(spark, d):
    return profiles.versus_opponent(participants(spark, d), ["damage"]).select("matchid", "participantid", "damage_diff", r("damage_advantage").alias("damage_advantage"))


@query("""WITH l AS (SELECT o_orderkey, sign(o_totalprice) * ln(1 + abs(o_totalprice)) AS v FROM orders), m AS (SELECT median(v) AS md FROM l), a AS (SELECT md, median(abs(v - md)) AS mad FROM l, m GROUP BY md)
SELECT o_orderkey, 'o_totalprice' AS metric, round(least(greatest((v - md) / CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 ELSE 1 END, -8), 8), 5) AS z FROM l, a""")
def pro10_standardise(spark, d):
    return profiles.standardise(table(spark, d, "orders"), ["o_totalprice"], ["o_orderkey"]).withColumn("z", r("z", 5))


BUCKET = "least((\"timestamp\" - (SELECT min(\"timestamp\") FROM ev)) // 86400000, 20)::INT"


@query("WITH " + EVENTS + f""", b AS (SELECT matchid AS k, matchid % 5 AS parent, {BUCKET} AS bucket, count(*) AS frames, sum(value) AS v FROM ev GROUP BY ALL)
SELECT k, bucket, frames, round(v, 4) AS v FROM b""")
def pro13_temporal_bins(spark, d):
    return _bins(spark, d).select("k", "bucket", "frames", r("v", 4).alias("v"))


def _bins(spark, d):
    ev = match_events(spark, d)
    first = ev.agg(F.min("timestamp").alias("first"))
    ev = ev.crossJoin(first).withColumn("k", F.col("matchid")).withColumn("parent", F.col("matchid") % 5)
    bucket = F.least(F.floor((F.col("timestamp") - F.col("first")) / 86_400_000), F.lit(20)).cast("int")
    return profiles.temporal_bins(ev, ["k", "parent"], bucket, {"v": F.col("value")})


@query("WITH " + EVENTS + f""", b AS (SELECT matchid AS k, matchid % 5 AS parent, {BUCKET} AS bucket, count(*) AS frames, sum(value) AS v FROM ev GROUP BY ALL),
w AS (SELECT bucket, sum(v) / sum(frames) AS world FROM b GROUP BY bucket), p AS (SELECT parent, bucket, sum(v) AS pv, sum(frames) AS pn FROM b GROUP BY ALL), i AS (SELECT DISTINCT k, parent FROM b),
g AS (SELECT i.k, i.parent, p.bucket, (pv + 1000 * world) / (pn + 1000) AS near FROM i JOIN p USING (parent) JOIN w USING (bucket))
SELECT g.k, g.parent, g.bucket, round((coalesce(b.v, 0) + 100 * near) / (coalesce(b.frames, 0) + 100), 6) AS mean, (coalesce(b.frames, 0) > 0)::INT AS observed FROM g LEFT JOIN b ON b.k = g.k AND b.bucket = g.bucket""")
def pro15_temporal_shrink(spark, d):
    return profiles.temporal_shrink(_bins(spark, d), "k", "parent", "v").withColumn("mean", r("mean"))


@query("WITH " + EVENTS + """ SELECT matchid, participantid, arg_max(value, "timestamp" * 1000000 + event_id) AS value FROM ev GROUP BY ALL""")
def pro2_final_snapshot(spark, d):
    ev = match_events(spark, d).withColumn("at", F.struct("timestamp", "event_id"))
    return profiles.final_snapshot(ev, ["matchid", "participantid"], "at", ["value"])


# --- evaluation, time, scalars ------------------------------------------------------------------------------------

PRED = "WITH e AS (SELECT least(o_totalprice / 400000, 1) AS p, (o_orderstatus = 'F')::INT AS y FROM orders)"


def _pred(spark, d):
    return table(spark, d, "orders").select(F.least(F.col("o_totalprice") / 400_000, F.lit(1.0)).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(PRED + ", q AS (SELECT *, least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS c FROM e) SELECT count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS nll, round(avg(pow(p - y, 2)), 6) AS brier FROM q")
def evl1_scores(spark, d):
    return evaluate.scores(_pred(spark, d)).select("n", *[r(c).alias(c) for c in ("accuracy", "nll", "brier")])


@query(PRED + ", b AS (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM e GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b")
def evl2_calibration_error(spark, d):
    return evaluate.calibration_error(_pred(spark, d)).withColumn("ece", r("ece"))


@query("SELECT round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(min(o_totalprice), 4) AS least, round(avg(o_totalprice), 4) AS mean, round(avg((o_totalprice < 20000)::INT), 6) AS below_floor FROM orders")
def evl4_mass_report(spark, d):
    out = evaluate.mass_report(table(spark, d, "orders"), "o_totalprice", 20_000)
    return out.select(*[r(c, 4).alias(c) for c in ("p10", "p50", "least", "mean")], r("below_floor").alias("below_floor"))


@query("WITH " + EVENTS + """ SELECT event_id, CASE WHEN "timestamp" <= 0 THEN 0 ELSE ("timestamp" + 30000) // 60000 * 60000 END AS nearest, least("timestamp" // 60000 % 100, 46)::INT AS bucket, CASE WHEN value > 1e-9 THEN round("timestamp" % 1000 / value, 6) ELSE 0 END AS ratio FROM ev""")
def tim1_minutes(spark, d):
    ev = match_events(spark, d)
    wrapped = F.floor(F.col("timestamp") / 60_000) % 100 * 60_000
    return ev.select("event_id", S.nearest_minute(F.col("timestamp")).alias("nearest"), S.minute_bucket(wrapped).alias("bucket"), r(S.ratio(F.col("timestamp") % 1000, F.col("value"))).alias("ratio"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scf54_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def str12_window_rollup(spark, d):
    from matchforge.streaming.ingest import minute_rollup

    ev = table(spark, d, "events")
    kind = dict(ev.dtypes)["ts"]
    out = minute_rollup(ev.withColumn("ts", F.col("ts").cast("timestamp")), width="1 hour").withColumn("value", r("value", 4))
    return out.withColumn("start", F.col("start").cast(kind))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, (embedding::DOUBLE[])[1:len(embedding) // 2] AS y FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS q, b.vec_id AS i, list_distance(a.x, b.x) AS dx, list_distance(a.y, b.y) AS dy FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dx, i) <= 10 AS nx, row_number() OVER (PARTITION BY q ORDER BY dy, i) <= 10 AS ny FROM p),
r AS (SELECT q, sum((nx AND ny)::INT) / sum(nx::INT) AS r FROM n GROUP BY q)
SELECT (SELECT count(*) FROM r) AS queries, count(*) AS pairs, (SELECT round(avg(r), 6) FROM r) AS recall, round(corr(dx, dy), 6) AS distance_correlation FROM p""")
def pro22_neighbours(spark, d):
    """Two spaces (all components; the first half): share of the ten nearest that they agree on, and how their distances correlate."""
    from matchforge.operators.spaces import neighbour_agreement

    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("whole"))
    e = e.withColumn("half", F.slice("whole", 1, F.floor(F.size("whole") / 2).cast("int")))
    return neighbour_agreement(e, "vec_id", "whole", "half", k=10, query_every=20).select("queries", "pairs", r("recall").alias("recall"), r("distance_correlation").alias("distance_correlation"))


DERIVED = ["takedowns", "net_kills", "kills_to_deaths_ratio", "assists_to_deaths_ratio", "takedowns_to_deaths_ratio", "kills_to_assists_ratio", "kills_to_assists_ratio_to_goldearned_ratio", "goldearned_to_deaths_ratio"]


@query(WITH + f""", i AS (SELECT championid, teamposition, build, {', '.join(f'sum({s})::DOUBLE AS {s}' for s in STATS)} FROM players GROUP BY ALL),
k AS (SELECT *, CASE WHEN assists > 1e-9 THEN kills / assists ELSE 0 END AS ka FROM i)
SELECT championid, teamposition, build, kills + assists AS takedowns, kills - deaths AS net_kills, round(CASE WHEN deaths > 1e-9 THEN kills / deaths ELSE 0 END, 6) AS kills_to_deaths_ratio, round(CASE WHEN deaths > 1e-9 THEN assists / deaths ELSE 0 END, 6) AS assists_to_deaths_ratio,
round(CASE WHEN deaths > 1e-9 THEN (kills + assists) / deaths ELSE 0 END, 6) AS takedowns_to_deaths_ratio, round(ka, 6) AS kills_to_assists_ratio, round(CASE WHEN goldearned > 1e-9 THEN ka / goldearned ELSE 0 END, 6) AS kills_to_assists_ratio_to_goldearned_ratio, round(CASE WHEN deaths > 1e-9 THEN goldearned / deaths ELSE 0 END, 6) AS goldearned_to_deaths_ratio FROM k""")
def pro8_derived_metrics(spark, d):
    from matchforge.functions.derived import add_derived

    base = profiles.identity_base(participants(spark, d), FIELDS[:3], STATS)
    out = add_derived(base, DERIVED)
    return out.select(*FIELDS[:3], "takedowns", "net_kills", *[r(n).alias(n) for n in DERIVED[2:]])


# --- shredding: payloads made from orders, taken apart again -------------------------------------------------------


def payloads(spark, d):
    """Match summaries as JSON text, one per order with five participants or more."""
    p = participants(spark, d).where("puuid is not null")
    who = F.struct(F.col("participantid").cast("int").alias("participantId"), F.col("puuid").cast("string").alias("puuid"), F.col("teamid").alias("teamId"), F.col("championid").alias("championId"), F.col("teamposition").alias("teamPosition"), (F.col("win") == 1).alias("win"), "kills", "deaths", "assists", (F.col("kills") * 100).alias("unrealKills"))
    g = p.groupBy("matchid", "season", "patch").agg(F.array_sort(F.collect_list(who)).alias("participants"))
    info = F.struct(F.lit("GameComplete").alias("endOfGameResult"), F.lit("CLASSIC").alias("gameMode"), F.concat_ws(".", "season", "patch", F.lit("7"), F.lit("1")).alias("gameVersion"), "participants")
    return g.select(F.to_json(F.struct(F.struct(F.col("matchid").cast("string").alias("matchId")).alias("metadata"), info.alias("info"))).alias("payload"))


LARGE = WITH + ", g AS (SELECT matchid FROM players GROUP BY matchid HAVING count(*) >= 5) "


@query(LARGE + "SELECT matchid::VARCHAR AS matchid, participantid AS \"participantId\", puuid::VARCHAR AS puuid, win, kills::INT AS kills, least(kills * 100, 255)::INT AS \"unrealKills\" FROM players SEMI JOIN g USING (matchid)")
def shr6_participant_stats(spark, d):
    from matchforge.sources.shred import shred_match

    return shred_match(payloads(spark, d))["participant_stats"].select("matchid", "participantId", "puuid", "win", "kills", "unrealKills")


@query(LARGE + "SELECT DISTINCT matchid::VARCHAR AS matchid, season, patch, '7.1' AS sub_version FROM players SEMI JOIN g USING (matchid)")
def shr2_info(spark, d):
    from matchforge.sources.shred import shred_match

    return shred_match(payloads(spark, d))["info"].select("matchid", "season", "patch", "sub_version")


def event_payloads(spark, d):
    """Timelines as JSON text, one per user: item purchases and kills from the event table."""
    ev = match_events(spark, d)
    one = F.struct("timestamp", F.when(F.col("event_type") == "purchase", "ITEM_PURCHASED").otherwise("CHAMPION_KILL").alias("type"), F.col("participantid").alias("participantId"), F.col("participantid").alias("killerId"), (F.col("event_id") % 7 + 1).cast("int").alias("victimId"), F.col("event_id").cast("int").alias("itemId"))
    frames = ev.groupBy("matchid", S.nearest_minute(F.col("timestamp")).alias("minute")).agg(F.array_sort(F.collect_list(one)).alias("events"))
    g = frames.groupBy("matchid").agg(F.array_sort(F.collect_list(F.struct(F.col("minute").alias("timestamp"), "events"))).alias("frames"))
    return g.select(F.to_json(F.struct(F.struct(F.col("matchid").cast("string").alias("matchId")).alias("metadata"), F.struct("frames").alias("info"))).alias("payload"))


@query("WITH " + EVENTS + """ SELECT matchid::VARCHAR AS matchid, ("timestamp" + 30000) // 60000 * 60000 AS frame_timestamp, "timestamp", participantid AS "participantId", event_id::INT AS "itemId" FROM ev WHERE event_type = 'purchase'""")
def shr11_6_item_purchased(spark, d):
    from matchforge.sources.shred import shred_timeline

    return shred_timeline(event_payloads(spark, d))["tl_item_purchased"]


@query("WITH " + EVENTS + """ SELECT matchid::VARCHAR || ':' || "timestamp" || ':' || participantid || ':' || (event_id % 7 + 1) AS champion_kill_event_id, participantid AS "killerId", (event_id % 7 + 1)::INT AS "victimId" FROM ev WHERE event_type <> 'purchase'""")
def shr12_champion_kill(spark, d):
    from matchforge.sources.shred import shred_timeline

    return shred_timeline(event_payloads(spark, d))["tl_champion_kill"].select("champion_kill_event_id", "killerId", "victimId")


# --- sums by key, arrays, medians ----------------------------------------------------------------------------------


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS listed, arg_max(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 100000000 + o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def agg_basic(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("finished"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("listed"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT metric, round(median, 4) AS median, round(mad, 4) AS mad FROM (SELECT 'l_quantity' AS metric, median(l_quantity) AS median, (SELECT median(abs(l_quantity - m)) FROM lineitem, (SELECT median(l_quantity) AS m FROM lineitem)) AS mad FROM lineitem UNION ALL SELECT 'l_extendedprice', median(l_extendedprice), (SELECT median(abs(l_extendedprice - m)) FROM lineitem, (SELECT median(l_extendedprice) AS m FROM lineitem)) FROM lineitem)")
def agg16_median_mad(spark, d):
    return profiles.median_mad(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("metric", r("median", 4).alias("median"), r("mad", 4).alias("mad"))


@query(WITH + "SELECT build, count(*) FILTER (WHERE role_index < 2) AS n, max(CASE WHEN early >= 3 AND late >= 3 THEN 1 ELSE 0 END)::INT AS enough FROM (SELECT *, count(*) FILTER (WHERE patch <= 2) OVER (PARTITION BY championid) AS early, count(*) FILTER (WHERE patch > 2) OVER (PARTITION BY championid) AS late FROM players) GROUP BY build")
def agg2_conditional(spark, d):
    """Counts under a condition: by (champion, build) first, then by champion, so no champion's rows meet in a task."""
    when = lambda c: F.count(F.when(c, 1))
    cells = participants(spark, d).groupBy("championid", "build").agg(when(F.col("role_index") < 2).alias("n"), when(F.col("patch") <= 2).alias("early"), when(F.col("patch") > 2).alias("late"))
    champions = cells.groupBy("championid").agg(((F.sum("early") >= 3) & (F.sum("late") >= 3)).cast("int").alias("enough"))
    return cells.join(champions, "championid").groupBy("build").agg(F.sum("n").alias("n"), F.max("enough").alias("enough"))


@query(WITH + """, n AS (SELECT championid, count(*) AS n, avg(CASE WHEN patch <= 2 THEN win END) AS early, avg(CASE WHEN patch > 2 THEN win END) AS late FROM players GROUP BY championid),
s AS (SELECT championid, n, round(late - early, 6) AS skew FROM n WHERE n >= 5 AND early IS NOT NULL AND late IS NOT NULL)
(SELECT *, 'late' AS "end" FROM s ORDER BY skew DESC, championid LIMIT 10) UNION ALL (SELECT *, 'early' AS "end" FROM s ORDER BY skew, championid LIMIT 10)""")
def scl5_skew_profiles(spark, d):
    return reports.skew_profiles(participants(spark, d), "championid", F.col("patch") <= 2, F.col("patch") > 2, 5)
