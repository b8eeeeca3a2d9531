"""Exact dedup by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name by sorting the distinct
blocks; then neighbouring names are paired and every distinct pair gets a name, again and again, until a document has
one name. Two documents have the same (number of blocks, name) if and only if their texts are equal: names stand for
contents, not for hashes.

Shuffles: the texts of distinct blocks travel once (copies are merged before the shuffle). Blocks find their names
through a 128-bit routing key; that no two different blocks share a key is counted, and if two ever did, another salt
is taken. So keys never decide equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import located, write_table

BLOCK_BYTES = 4096
SPACE_PATTERN = "[ \\t\\n\\x0B\\f\\r]+"


def without_spaces(text):
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, "")


def _blocks(content, n_blocks, size: int):
    """Array of the fixed-size blocks of a binary column; the last may be shorter."""
    places = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(content, i * size + 1, F.lit(size)))


def _keys(block, salt: int):
    return F.struct(F.xxhash64(F.lit(2 * salt), block).alias("h1"), F.xxhash64(F.lit(2 * salt + 1), block).alias("h2"))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names of distinct rows: places in the sorted order of each shuffle partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: row, doc_id, n_points, text_sha256, n_blocks, name. Equal texts have equal (n_blocks, name).

    Null and white-space-only texts have 0 blocks and the name -1. Repeated rows stay apart by `row`. An empty table gives
    an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_at"), F.lit(0).cast("long").alias("_block"))
    return _named_rows(base, block_bytes).drop("_block", "_at")


def _named_rows(base: DataFrame, block_bytes: int) -> DataFrame:
    base = base.select("_block", "_at", "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    content = F.encode(without_spaces(F.col("text")), "UTF-8")
    cut = base.select("_block", "_at", "doc_id", "text", content.alias("content"))
    cut = cut.withColumn("n_blocks", F.ceil(F.octet_length("content") / block_bytes).cast("int"))
    cut = cut.withColumn("blocks", _blocks(F.col("content"), F.col("n_blocks"), block_bytes))

    salt = 0
    while True:
        s = salt
        texts = cut.select(F.explode("blocks").alias("block")).select(_keys(F.col("block"), s).alias("key"), "block").select("key.*", "block")
        names = write_table(_named(texts.groupBy("h1", "h2", "block").agg(F.count("*").alias("copies")), ["block"]).drop("block"), "block-names")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        salt += 1

    rows = write_table(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "_block",
            "_at",
            "doc_id",
            F.char_length("text").alias("n_points"),
            F.sha2("content", 256).alias("text_sha256"),
            "n_blocks",
            F.transform("blocks", lambda b: _keys(b, salt)).alias("keys"),
        ),
        "block-keys",
    )
    placed = rows.where("n_blocks > 0").select("row", "n_blocks", F.posexplode("keys").alias("pos", "key")).select("row", "n_blocks", "pos", "key.*")
    level = placed.join(names.drop("copies"), ["h1", "h2"]).select("row", "n_blocks", "pos", "name", F.col("n_blocks").alias("left"))
    most = rows.agg(F.max("n_blocks")).first()[0] or 0

    done = []
    while most > 1:
        level = write_table(level, "block-level")
        done.append(level.where("left = 1").select("row", "name"))
        pairs = (
            level.where("left > 1")
            .groupBy("row", "n_blocks", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pair_names = write_table(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level = pairs.join(pair_names, ["a", "b"]).select("row", "n_blocks", "pos", "name", F.ceil(F.col("left") / 2).cast("int").alias("left"))
        most = -(-most // 2)
    named = level.select("row", "name")
    for part in done:
        named = named.unionByName(part)
    return rows.drop("keys").join(named, "row", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts: row, doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Of equal texts, the row with the most code points stays, then the smallest id (a null id comes last), then the
    first row; `kept` marks exactly one row of each group, also where ids repeat. Null, empty and white-space-only texts are
    equal. Other columns do not matter. An empty table gives an empty result.
    """
    base = docs.select(F.lit(0).cast("long").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _groups(base, block_bytes).drop("_block", "_at")


def _groups(base: DataFrame, block_bytes: int) -> DataFrame:
    members = write_table(_named_rows(base, block_bytes), "named")
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = members.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = write_table(groups.select("n_blocks", "name", "group_size", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")), "copies")
    alone = F.col("group_size").isNull()
    return members.join(groups, ["n_blocks", "name"], "left").select(
        "_block",
        "_at",
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, one of each group, with all their columns, whatever these are called.

    Rows are told apart by their place in the files, so ids may be null or repeat. Of null, empty and white-space-only texts
    one row stays. An empty table gives an empty result. The plan is the same at every size: a sort-merge join by place.
    """
    placed = located(docs)
    base = placed.select("_block", "_at", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text}`").alias("text"))
    kept = _groups(base, BLOCK_BYTES).where("kept").select("_block", "_at")
    return placed.join(kept.hint("merge"), ["_block", "_at"], "left_semi").select("row.*")
