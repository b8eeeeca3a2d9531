"""The registered queries opN_<name>, one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchforge.llm import chat_format, exact_dedup, line_runs, minmax_dedup, mixing, packing, periodic_runs, quality_lm, token_shards, topk_search, toxicity, warc_zstd, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are empty; ties in `turn` are ordered by role and text; repeated rows are turns of their own."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_digests(chat_format.format_conversations(turns))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts hold the end id only; repeated rows are documents of their own; an empty table writes no shard."""
    shards = token_shards.write_shards(_table(spark, sf_dir, "documents"))
    return token_shards.read_shards(shards).select("slot", "sequence", "shard", "offset", "tokens", "ids", "ids_crc32")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload, null urls are empty, any character of a url comes back; rows of equal id are records of their own."""
    records = warc_zstd.read_archives(warc_zstd.write_archives(_table(spark, sf_dir, "pages")), payloads=False)
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') as bigint)")  # noqa: E731  after urn:page:
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like texts without any term; repeated rows are scored alike."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no perplexity and are kept; null languages have the limits over all trusted texts."""
    model = quality_lm.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_lm.judge(model).select("doc_id", "lang", "symbols", "perplexity", "threshold", "compressed", "least", "kept")


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and word-free texts are linked with nothing; rows of equal sets are linked; an empty table gives no rows."""
    found = minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts hold the end id only; repeated rows are documents of their own; an empty table gives no rows."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null or hold null or non-finite components take no part; ties go to the smaller id."""
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty, and all texts of white space only are equal; repeated rows are members of their group."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0 and are never taken; null is a source; repeated rows are documents of their own."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one empty line, which always stays; repeated rows are documents of their own."""
    rows = line_runs.without_frequent_lines(_table(spark, sf_dir, "documents"), documents=10, least_points=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def planted_period(doc_id: int | None, words: list) -> list:
    """The words of one document in ten end in a repetition that follows from its id; rows without an id stay as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no runs; repeated rows are documents of their own."""
    rows = periodic_runs.repeated_words(_table(spark, sf_dir, "documents"), least=12, rewrite=planted_period)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = rows.withColumns({"best": longest, "lines": lines})
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null or hold null or non-finite components take no part; see whitening.whitened for other lengths and ties."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages over all documents; see corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_page FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN last_page END AS refers_to
FROM m
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

OP9_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

OP11_SQL = """
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""


def queries() -> dict:
    ops = [op1_chat_windows, op2_token_shards, op3_warc_revisits, op4_weak_toxicity, op5_kneser_ney, op6_minmax_dedup, op7_online_packing, op8_segment_topk, op9_block_naming, op10_golden_mix, op11_line_runs, op12_lyndon_runs, op13_lanczos_whitening, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": OP3_SQL, "op8_segment_topk": OP8_SQL, "op9_block_naming": OP9_SQL, "op11_line_runs": OP11_SQL}
