"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative slot shares of the sources, so that every stretch of the
schedule holds each source in about its share. Slots are ranked per source; a source's documents are shuffled by a
seeded hash, laid end to end, repeated where the target exceeds the source, and cut into blocks of equally many
words. Slot r of a source takes its block r. Only ids and sizes are shuffled, never texts; every order inside a
source is built from two levels of sums, so no task sees a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.llm._common import located, ranked, running_sums, with_marks, word_count, write_table

BLOCK_WORDS = 1024
MAX_REPEATS = 3
#: The golden ratio's fraction as a share of 2^64, so that points are exact integers for any number of slots.
GOLDEN, WHOLE = 0x9E3779B97F4A7C15, 1 << 64
ROWS_A_BUCKET = 5_000
SLOTS_A_CHUNK = 65_536
BINS = 1024


@dataclass
class Mix:
    """documents: _block, _at (see located), row, doc_id, source, size, source_size, target, taken. pieces: slot, source, block, row, doc_id, repeat, start, words."""

    documents: DataFrame
    pieces: DataFrame
    sources: DataFrame


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources: place, source, source_size, weight, target (double), words (target rounded).

    `sizes` has one row per source with `source_size`. Sources in code-point order, null last, weigh 1, 2, 3, repeating,
    and share the sum of all sizes. A target stops at `max_repeats` times its source; the excess is shared again by weight
    until none is above: in the order of limit by weight, the sources that stop are the first ones, as long as the share of
    those that are left is above their limit. The driver sees a few sums only.
    """
    rows = ranked(sizes, [F.col("source").isNull(), F.col("source")], "place").withColumn("weight", F.col("place") % 3 + 1)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = write_table(running_sums(rows, ["ratio", "place"], {"caps": F.col("cap"), "weights": F.col("weight")}), "sources")
    total, weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    stops = F.col("ratio") * (F.lit(weights) - F.col("weights")) < F.lit(total) - F.col("caps")
    used, held = rows.where(stops).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (total - used) / (weights - held) if weights > held else 0.0
    rows = rows.withColumn("target", F.when(stops, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")))
    rows = rows.withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).cast("long"))
    return rows.select("place", "source", "source_size", "weight", "target", "words")


def golden_slots(sources: DataFrame, total_slots: int) -> DataFrame:
    """Slots of the schedule: slot, place, rank (0-based per source). `sources` has place, first_slot and slots (counts).

    Slot i stands at the point i * golden ratio mod 1. A source gets its `slots` exactly: points beyond are left out, and
    the few that low discrepancy leaves missing follow after the last slot.
    """
    spark = sources.sparkSession
    width = max(1, -(-total_slots // BINS))
    whole = F.lit(Decimal(WHOLE))
    point = (F.col("id").cast("decimal(18,0)") * F.lit(Decimal(GOLDEN))) % whole
    points = spark.range(total_slots).select(F.col("id").alias("slot"), F.floor(point.cast("decimal(20,0)") * F.lit(total_slots).cast("decimal(18,0)") / whole).cast("long").alias("v"))
    spans = sources.where("slots > 0").select("place", "slots", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor((F.col("end_slot") - 1) / width))))
    dealt = points.withColumn("bin", F.floor(F.col("v") / width)).join(spans, "bin").where("v >= first_slot and v < end_slot")
    dealt = write_table(dealt.select("slot", "place", "slots", F.floor(F.col("slot") / SLOTS_A_CHUNK).alias("chunk")), "slots")
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.groupBy("place", "chunk").count().select("place", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    held = dealt.withColumn("in", inside).join(chunks, ["place", "chunk"]).select("slot", "place", (F.col("before") + F.col("in")).alias("rank"), "slots").where("rank < slots")
    counts = dealt.groupBy("place").count()
    short = sources.where("slots > 0").join(counts, "place", "left").select("place", "slots", F.coalesce("count", F.lit(0)).alias("held")).where("held < slots")
    late = short.select("place", F.explode(F.sequence("held", F.col("slots") - 1)).alias("rank"))
    late = ranked(late, ["rank", "place"], "late").select((F.col("late") + total_slots).alias("slot"), "place", "rank")
    return held.select("slot", "place", "rank").unionByName(late)


def mix_sources(docs: DataFrame, seed: int = 17, text: str = "text", id_col: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> Mix:
    """Choose how many words of every document a mix takes, and in which slot each stands.

    Null texts and texts without words have size 0 and are never taken. Null is a source of its own. Repeated rows are
    documents of their own. The order depends on seed, id and text only, so reruns agree. An empty table gives empty results.
    """
    return _mix(located(docs), seed, text, id_col, source, block_words, max_repeats)


def _mix(docs: DataFrame, seed: int, text: str, id_col: str, source: str, block_words: int, max_repeats: int) -> Mix:
    content, name = F.col(f"row.`{text}`"), F.col(f"row.`{id_col}`")
    base = docs.select("_block", "_at", name.cast("long").alias("doc_id"), F.col(f"row.`{source}`").cast("string").alias("source"), word_count(content).alias("size"), F.xxhash64(F.lit(seed), name, content).alias("h"))
    rows = write_table(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, max_repeats).withColumn("slots", F.ceil(F.col("words") / block_words).cast("long"))
    sources = write_table(running_sums(sources, ["place"], {"first_slot": F.col("slots")}), "targets")
    total_slots, n_rows = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0], rows.count()

    # Place of each document in its source's shuffled stream: sums of buckets of the hash, then sums inside a bucket.
    buckets = max(256, -(-n_rows // ROWS_A_BUCKET) * 4)
    placed = rows.join(sources.select(F.col("source").alias("_s"), "place", "source_size", "target", "words"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = write_table(placed.withColumn("bucket", F.pmod("h", F.lit(buckets))), "placed")
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("place", "bucket").agg(F.sum("size").alias("n")).select("place", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    stream = placed.where("size > 0").withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["place", "bucket"]).withColumn("at", F.col("at") + F.col("offset"))

    # Each repeat of a document covers a span of the repeated stream; spans are cut at block borders.
    last = F.floor((F.col("words") - F.col("at") - 1) / F.col("source_size"))
    turns = stream.where("words > at").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("at", F.col("at") + F.col("repeat") * F.col("source_size"))
    turns = turns.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("words")))
    cut = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words))))
    begin, end = F.greatest(F.col("at"), F.col("block") * block_words), F.least(F.col("end"), (F.col("block") + 1) * block_words)
    cut = cut.select("place", "source", "block", "row", "doc_id", "repeat", (begin - F.col("at")).alias("start"), (end - begin).alias("words"))
    slots = golden_slots(sources.select("place", "slots", "first_slot"), total_slots).withColumnRenamed("rank", "block")
    pieces = write_table(cut.join(slots, ["place", "block"]).select("slot", "source", "block", "row", "doc_id", "repeat", "start", "words"), "pieces")

    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, "row", "left").select("_block", "_at", "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(documents, pieces, sources)


def mixed_documents(docs: DataFrame, seed: int = 17, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Whole documents in the mix's proportions: as many copies as the words taken come to, rounded to the nearest.

    A mix takes all documents of a source equally often, but for one stretch that it takes once more, so only the document
    in which that stretch ends is rounded, and left out if less than half of it is taken. Documents without words are left
    out. All columns of `docs` stay, whatever these are called, and texts stay where they are. An empty table gives an empty result.
    """
    placed = located(docs)
    mix = _mix(placed, seed, text, id_col, source, BLOCK_WORDS, MAX_REPEATS)
    copies = mix.documents.select("_block", "_at", F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    return with_marks(placed, copies).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
