"""The test tables seen as matches: an order is a match, its lines are participants, events are timeline events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.derived import NAMES, inputs
from matchforge.functions.formulas import FRAME, QUANTITY, TOTAL
from matchforge.functions.scalar import ROLES, nearest_minute
from matchforge.operators.selection import chrono_split
from matchforge.sources.shred import EVENTS as SHREDDED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a task sorts and groups at most, as a mean. Larger tables have more tasks than the session's shuffles.
LINES_OF_A_TASK = 500_000


def _lines(spark: SparkSession, sf_dir: str, of_a_task: int | None = None) -> DataFrame:
    """Lines with their part and order, numbered inside the order. The small side is joined first and the window is last,
    so that everything by match after it needs no further shuffle, and tasks hold as many lines of large tables as of small ones."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    tasks, least = -(-lines.count() // (of_a_task or LINES_OF_A_TASK)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if of_a_task or tasks > least:
        rows = rows.repartition(max(tasks, least), "l_orderkey")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.withColumn("participantid", place)


def participants(spark: SparkSession, sf_dir: str, of_a_task: int | None = None) -> DataFrame:
    """All lines as participants, with statistics made from line values. Lines beyond the tenth take the roles in turn again.
    `of_a_task`: lines of a task, as a mean, where what is made of them is wide; tasks are then not joined for being narrow."""
    rows = _lines(spark, sf_dir, of_a_task)
    blue = F.col("participantid") % 2 == 1
    seat = F.floor((F.col("participantid") - 1) / 2).cast("int") % 5
    role = F.element_at(F.array(*map(F.lit, ROLES)), seat + 1)
    blue_win = (F.col("o_orderstatus") == "F").cast("int")
    qty = F.col("l_quantity").cast("long")
    return rows.select(
        F.col("l_orderkey").alias("matchid"), "participantid", F.when(blue, 100).otherwise(200).alias("teamid"), role.alias("teamposition"), seat.alias("role_index"),
        F.col("p_size").cast("int").alias("championid"), F.col("p_type").alias("build"), F.col("p_brand").alias("brand"), F.col("l_suppkey").cast("long").alias("puuid"), F.when(blue, blue_win).otherwise(1 - blue_win).alias("win"),
        (qty % 13).alias("kills"), (qty % 7).alias("deaths"), (qty % 11).alias("assists"), F.floor("l_extendedprice").cast("long").alias("goldearned"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount") * 6)).cast("long").alias("goldspent"),
        F.floor(F.col("l_extendedprice") / 10).cast("long").alias("damage"), (qty * 3).alias("totalminionskilled"), (qty % 5).alias("neutralminionskilled"), (qty * 60).alias("timeplayed"), (qty % 9).alias("spellcasts"), (qty % 6).alias("itemspurchased"),
        F.year("o_orderdate").alias("season"), F.quarter("o_orderdate").alias("patch"), F.col("o_orderdate").alias("started"),
    )


#: The same rows in SQL, as common table expressions to put before a query.
PARTICIPANTS = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pid FROM lineitem),
players AS (
  SELECT l_orderkey AS matchid, pid::INT AS participantid, CASE WHEN pid % 2 = 1 THEN 100 ELSE 200 END AS teamid,
    ['TOP','JUNGLE','MIDDLE','BOTTOM','UTILITY'][((pid - 1) // 2 % 5 + 1)::INT] AS teamposition, ((pid - 1) // 2 % 5)::INT AS role_index,
    p_size::INT AS championid, p_type AS build, p_brand AS brand, l_suppkey::BIGINT AS puuid,
    CASE WHEN pid % 2 = 1 THEN (o_orderstatus = 'F')::INT ELSE 1 - (o_orderstatus = 'F')::INT END AS win,
    l_quantity::BIGINT % 13 AS kills, l_quantity::BIGINT % 7 AS deaths, l_quantity::BIGINT % 11 AS assists,
    floor(l_extendedprice)::BIGINT AS goldearned, floor(l_extendedprice * (1 - l_discount * 6))::BIGINT AS goldspent,
    floor(l_extendedprice / 10)::BIGINT AS damage, l_quantity::BIGINT * 3 AS totalminionskilled, l_quantity::BIGINT % 5 AS neutralminionskilled,
    l_quantity::BIGINT * 60 AS timeplayed, l_quantity::BIGINT % 9 AS spellcasts, l_quantity::BIGINT % 6 AS itemspurchased,
    year(o_orderdate)::INT AS season, quarter(o_orderdate)::INT AS patch, o_orderdate AS started
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SPLIT = """,
games AS (SELECT o_orderkey AS matchid, year(o_orderdate)::INT AS season, quarter(o_orderdate)::INT AS patch, o_orderdate AS started FROM orders),
placed AS (SELECT matchid, row_number() OVER (PARTITION BY season, patch ORDER BY started, matchid) AS i, count(*) OVER (PARTITION BY season, patch) AS n FROM games),
split AS (SELECT matchid, CASE WHEN i <= greatest(floor(n * 0.8::DOUBLE), 1) THEN 'train' ELSE 'test' END AS split FROM placed),
sp AS (SELECT p.*, s.split FROM players p JOIN split s USING (matchid))"""


def match_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matchid, split of every match: it needs no lines."""
    o = table(spark, sf_dir, "orders")
    games = o.select(F.col("o_orderkey").alias("matchid"), F.year("o_orderdate").alias("season"), F.quarter("o_orderdate").alias("patch"), F.col("o_orderdate").alias("started"))
    return chrono_split(games, ["season", "patch"], ["started", "matchid"]).select("matchid", "split")


def split_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with the chronological split of their match."""
    return participants(spark, sf_dir).join(match_split(spark, sf_dir), "matchid")


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline: match by user, participant by event id, milliseconds since the epoch."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("matchid"), (F.col("event_id") % 10 + 1).cast("int").alias("participantid"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "value", "props")


EVENTS = """ev AS (SELECT event_id, user_id AS matchid, (event_id % 10 + 1)::INT AS participantid, event_type, epoch_us(ts) // 1000 AS "timestamp", value, props FROM events)"""


#: Raw statistics that the metrics read; their values are made from line values, each by its own numbers.
RAW = sorted({n for f in (*QUANTITY.values(), *TOTAL.values()) for n in re.findall(r"[a-z]{4,}", f)} - {"greatest"} | {n for name in NAMES for n in inputs(name)})


def _raw_value(i: int) -> str:
    return f"(l_quantity * {i + 3} + l_partkey * {i % 5 + 1} + l_linenumber) % {13 + 7 * (i % 11)}"


def wide_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with all raw statistics of the metrics."""
    rows = _lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity").cast("long"))
    seat = F.floor((F.col("participantid") - 1) / 2).cast("int") % 5
    head = [F.col("l_orderkey").alias("matchid"), "participantid", F.when(F.col("participantid") % 2 == 1, 100).otherwise(200).alias("teamid"), F.element_at(F.array(*map(F.lit, ROLES)), seat + 1).alias("teamposition"), F.col("p_size").cast("int").alias("championid"), F.col("p_type").alias("build"), (F.col("l_quantity") * 60).alias("timeplayed")]
    return rows.select(*head, *[F.expr(_raw_value(i)).cast("long").alias(n) for i, n in enumerate(RAW)])


WIDE = (
    """lines AS (SELECT * REPLACE (l_quantity::BIGINT AS l_quantity), row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pid FROM lineitem),
wide AS (SELECT l_orderkey AS matchid, pid::INT AS participantid, CASE WHEN pid % 2 = 1 THEN 100 ELSE 200 END AS teamid, ['TOP','JUNGLE','MIDDLE','BOTTOM','UTILITY'][((pid - 1) // 2 % 5 + 1)::INT] AS teamposition,
  p_size::INT AS championid, p_type AS build, l_quantity * 60 AS timeplayed, """
    + ", ".join(f"({_raw_value(i)})::BIGINT AS {n}" for i, n in enumerate(RAW))
    + " FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
)

#: Statistics of minute frames that the frame metrics read.
FRAMES = sorted({n for f in FRAME.values() for n in re.findall(r"[a-z]{5,}", f)} - {"greatest"})


def _frame_value(i: int) -> str:
    return f"(event_id * {i + 3} + user_id) % {17 + 6 * (i % 7)}"


def minute_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as participant frames: one per event."""
    ev = match_events(spark, sf_dir).withColumn("user_id", F.col("matchid"))
    return ev.select("event_id", "matchid", "participantid", nearest_minute(F.col("timestamp")).alias("frame_timestamp"), *[F.expr(_frame_value(i)).cast("long").alias(n) for i, n in enumerate(FRAMES)])


FRAME_ROWS = (
    """frames AS (SELECT event_id, matchid, participantid, CASE WHEN "timestamp" <= 0 THEN 0 ELSE ("timestamp" + 30000) // 60000 * 60000 END AS frame_timestamp, """
    + ", ".join(f"(({_frame_value(i)}))::BIGINT AS {n}".replace("user_id", "matchid") for i, n in enumerate(FRAMES))
    + " FROM ev)"
)

KINDS = [kind for kind, _ in SHREDDED.values()]
MONSTERS = [("ATAKHAN", None), ("BARON_NASHOR", None), *(("DRAGON", f"{k}_DRAGON") for k in ("AIR", "CHEMTECH", "EARTH", "ELDER", "FIRE", "HEXTECH", "WATER")), ("HORDE", None), ("RIFTHERALD", None)]


def _event_fields(spark_sql: bool) -> dict[str, str]:
    """Fields of timeline events made from the event's number, as SQL of Spark or DuckDB."""
    h, g = ("cast(floor(event_id / 23) as int)", "cast(floor(event_id / 69) as int)") if spark_sql else ("(event_id // 23)::INT", "(event_id // 69)::INT")

    def pick(items, i):
        held = ", ".join("NULL" if x is None else f"'{x}'" for x in items)
        return f"element_at(array({held}), cast({i} as int) + 1)" if spark_sql else f"([{held}])[({i})::INT + 1]"

    # A higher-order function: with it the projection of all fields is compiled in small methods. As one method it is too long for the JIT compiler.
    numbers = f"filter(array(1, 2, 3), x -> x <= {h} % 4)" if spark_sql else f"range(1, {h} % 4 + 1)::INT[]"
    as_int, as_long = ("cast({} as int)", "cast({} as bigint)") if spark_sql else ("({})::INT", "({})::BIGINT")
    kind = pick([*KINDS, "CHAMPION_KILL", "CHAMPION_KILL", "CHAMPION_KILL", "LEVEL_UP"][:23], "event_id % 23")
    fields = {
        "type": kind, "participantId": as_int.format("event_id % 10 + 1"), "creatorId": as_int.format(f"{h} % 10 + 1"), "killerId": as_int.format(f"{h} % 11"), "victimId": as_int.format(f"({h} * 3 + 1) % 10 + 1"),
        "itemId": as_int.format(f"{h} % 97"), "beforeId": as_int.format(f"{h} % 31"), "afterId": as_int.format(f"{h} % 29"), "goldGain": as_int.format(f"{h} % 300"), "level": as_int.format(f"{h} % 18 + 1"), "skillSlot": as_int.format(f"{h} % 4 + 1"),
        "levelUpType": pick(["NORMAL", "EVOLVE"], f"{h} % 2"), "wardType": pick(["YELLOW_TRINKET", "CONTROL_WARD", None], f"{h} % 3"), "killType": pick(["KILL_FIRST_BLOOD", "KILL_ACE", "KILL_MULTI"], f"{h} % 3"),
        "multiKillLength": f"CASE WHEN {h} % 3 = 2 THEN {as_int.format(f'{g} % 4 + 2')} END", "killStreakLength": as_int.format(f"{h} % 5"), "bounty": as_int.format(f"{h} % 7 * 50"), "shutdownBounty": as_int.format(f"{h} % 4 * 25"),
        "monsterType": pick([m for m, _ in MONSTERS], f"{h} % 11"), "monsterSubType": pick([s for _, s in MONSTERS], f"{h} % 11"), "killerTeamId": as_int.format(f"{h} % 2 * 100 + 100"), "teamId": as_int.format(f"{g} % 2 * 100 + 100"),
        "name": pick(["Ocean", "Cloud", None], f"{h} % 3"), "buildingType": f"CASE WHEN {h} % 4 = 0 THEN 'INHIBITOR_BUILDING' ELSE 'TOWER_BUILDING' END", "towerType": f"CASE WHEN {h} % 4 > 0 THEN {pick(['OUTER_TURRET', 'INNER_TURRET', 'BASE_TURRET', 'NEXUS_TURRET'], f'{g} % 4')} END",
        "laneType": pick(["TOP_LANE", "MID_LANE", "BOT_LANE"], f"{h} % 3"), "winningTeam": as_int.format(f"{h} % 2 * 100 + 100"), "gameId": f"CASE WHEN {h} % 2 = 0 THEN {as_long.format('event_id')} END", "realTimestamp": '"timestamp" + 7' if not spark_sql else "timestamp + 7",
        "actualStartTime": '"timestamp" + 11' if not spark_sql else "timestamp + 11", "featType": as_int.format(f"{h} % 3"), "featValue": as_int.format(f"{h} % 1001"), "transformType": pick(["ASSASSIN", "SLAYER"], f"{h} % 2"),
        "assistingParticipantIds": f"CASE WHEN {h} % 4 > 0 THEN {numbers} END", "position_x": as_int.format("event_id % 15000"), "position_y": as_int.format("event_id % 14000"),
    }
    return fields


def timeline(spark: SparkSession, sf_dir: str, of_a_task: int | None = None) -> DataFrame:
    """Events as timeline events of all kinds, with all fields that kinds of events have. `of_a_task`: events of a task, as a mean;
    they are then dealt by match before they get their fields, as the table is small on disk and a scan of it has few tasks."""
    ev = match_events(spark, sf_dir).select("event_id", "matchid", "timestamp")
    if of_a_task:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ev.count() // of_a_task))
        ev = ev.repartition(tasks, "matchid")
    return ev.select("event_id", "matchid", nearest_minute(F.col("timestamp")).alias("frame_timestamp"), "timestamp", *[F.expr(x).alias(n) for n, x in _event_fields(True).items()])


TIMELINE = (
    EVENTS
    + """, tl AS (SELECT event_id, matchid, CASE WHEN "timestamp" <= 0 THEN 0 ELSE ("timestamp" + 30000) // 60000 * 60000 END AS frame_timestamp, "timestamp", """
    + ", ".join(f'{x} AS "{n}"' for n, x in _event_fields(False).items())
    + " FROM ev)"
)
