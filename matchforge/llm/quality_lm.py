"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over n-grams of whole code points, of order 4, so its tables grow with the trusted text and its scripts. All
trusted text is counted. Counts, continuation counts, context totals, discounts and the probabilities of all n-grams that
documents hold are Spark aggregates and joins, keyed (and so sharded) by n-gram. Documents ask by block, a stretch of an
input file: a task sends each n-gram of its block once, and later loads no more than its block's answers.

A document is rejected if its perplexity is above a quantile, for its language, of the perplexities of trusted documents,
times a margin; or if it repeats itself: if deflate makes less of it than a low quantile, for its language, of what it
makes of trusted documents, divided by that margin. Repeated words have low perplexity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import located, read_block, scratch_path, small_batches, tidy, with_marks, write_blocks, write_table

ORDER = 4
QUANTILE = 0.999
MARGIN = 1.1
REPEAT_QUANTILE = 0.001
#: Characters whose n-grams a task holds before it merges them.
MERGE_CHARS = 400_000


_STATE: dict = {}


def gram_keys(text: str):
    """(points, keys): the code points of the text after ORDER - 1 line ends, and a 64-bit key of the n-gram that ends at each character."""
    import numpy as np

    if "mixed" not in _STATE:
        z = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _STATE["mixed"] = z ^ (z >> np.uint64(31))
    points = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    m = _STATE["mixed"][points]
    n = len(points) - ORDER + 1
    keys = m[:n].copy()
    for k in range(1, ORDER):
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys += m[k : k + n]
    return points, keys.view(np.int64)


def count_grams(base: DataFrame, trusted: str) -> DataFrame:
    """(_block, key, gram, c): the n-grams of each block's texts, and how often trusted texts hold them; `base` is
    (_block, _at, text), and the folder `trusted` has `_at` of the trusted texts of every block.

    A task merges the n-grams of its block before they are sent on, so it holds no more than one piece of a file has."""
    small_batches(base.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("_block", pa.int64()), ("key", pa.int64()), ("gram", pa.string()), ("c", pa.int64())])
        block, ids, held, waiting, chars = None, set(), None, [], 0

        def merge():
            nonlocal held, waiting, chars
            if waiting:
                points = np.concatenate([p for p, _, _ in waiting])
                keys = np.concatenate([k for _, k, _ in waiting])
                count = np.concatenate([np.full(len(k), good, np.int64) for _, k, good in waiting])
                starts = np.cumsum([0, *(len(p) for p, _, _ in waiting[:-1])])
                at = np.concatenate([np.arange(len(k)) + s for s, (_, k, _) in zip(starts, waiting)])
                keys, first, count = distinct(keys, count)
                found = keys, points[at[first][:, None] + np.arange(ORDER)], count
                if held is not None:
                    keys, points, count = (np.concatenate(x) for x in zip(held, found))
                    keys, first, count = distinct(keys, count)
                    found = keys, points[first], count
                held, waiting, chars = found, [], 0

        def distinct(keys, count):
            order = np.argsort(keys)
            keys = keys[order]
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[bounds], order[bounds], np.add.reduceat(count[order], bounds)

        def done():
            merge()
            for i in range(0, 0 if held is None else len(held[0]), 100_000):
                keys, points, count = (x[i : i + 100_000] for x in held)
                text = np.ascontiguousarray(points).tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[j : j + ORDER] for j in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block), pa.int64()), pa.array(keys), pa.array(grams, pa.string()), pa.array(count)], schema=schema)

        for batch in batches:
            for b, i, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != block:
                    yield from done()
                    rows = read_block(trusted, b, ["_at"])
                    block, ids, held = b, set() if rows is None else set(rows.column("_at").to_pylist()), None
                if t:
                    waiting.append((*gram_keys(t), int(i in ids)))
                    chars += len(t)
                    if chars > MERGE_CHARS:
                        merge()
        yield from done()

    return base.mapInArrow(tidy(run), "_block long, key long, gram string, c long")


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from counts of counts; kept within 0 and the count."""
    n = {int(r[0]): r[1] for r in grams.where("c <= 4").groupBy("c").count().collect()}
    y = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) and n.get(k + 1) else 0.5 * k
        out.append(min(float(k), max(0.0, d)))
    return tuple(out)


def train(base: DataFrame, trusted: DataFrame) -> str | None:
    """Train on all texts of trusted ids and look up every n-gram of `base` (_block, _at, doc_id, text); returns the folder of
    the model, or None if there is no trusted character.

    Tables: grams (n, gram, c, p: the interpolated probability) of all texts, contexts (n, context, total, held) and,
    by block, scores (key, logp). Every join is keyed, and so sharded, by n-gram.
    """
    spark = base.sparkSession
    folder = scratch_path(spark, "kneser-ney")
    write_blocks(base.select("_block", "_at", "doc_id").join(trusted, F.col("doc_id") == F.col("_trusted"), "left_semi").select("_block", "_at"), f"{folder}/trusted")
    base = base.select("_block", "_at", "text")
    found = write_table(count_grams(base, f"{folder}/trusted"), "found")
    grams = {ORDER: write_table(found.groupBy("gram").agg(F.sum("c").alias("c")), "grams")}
    if grams[ORDER].where("c > 0").isEmpty():
        return None
    for n in range(ORDER - 1, 0, -1):
        grams[n] = write_table(grams[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), "grams")
    lower = None
    for n in range(1, ORDER + 1):
        seen = grams[n].where("c > 0")
        d = discounts(seen)
        by = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        by = F.least(by, F.col("c").cast("double"))
        sums = [F.sum("c").alias("total"), F.sum(by).alias("held")]
        if lower is None:
            total, held, known = seen.agg(*sums, F.count("*")).first()
            contexts = spark.createDataFrame([("", total, held)], "context string, total long, held double")
            rows = grams[n].withColumn("p", (F.col("c") - by) / total + held / total / (known + 1))
        else:
            contexts = write_table(seen.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(*sums), "contexts")
            rows = grams[n].withColumn("context", F.substring("gram", 1, n - 1)).join(contexts, "context", "left").join(lower, F.substring("gram", 2, n - 1) == F.col("gram_"))
            rows = rows.withColumn("p", F.coalesce((F.col("c") - by) / F.col("total") + F.col("held") / F.col("total") * F.col("p_"), F.col("p_")))
        rows = write_table(rows.select("gram", "c", "p"), f"p{n}")
        contexts.select(F.lit(n).alias("n"), "context", "total", "held").write.mode("append").parquet(f"{folder}/contexts")
        seen_rows = rows.where("c > 0").select(F.lit(n).alias("n"), "gram", "c", "p")
        seen_rows.write.mode("append").parquet(f"{folder}/grams")
        lower = rows.select(F.col("gram").alias("gram_"), F.col("p").alias("p_"))
    write_blocks(found.join(rows, "gram").select("_block", "key", F.log("p").cast("float").alias("logp")), f"{folder}/scores")
    return folder


def compressed(text: str) -> float:
    """Bytes of the deflated text by bytes of the text. Its window of 32 KB keeps long texts comparable with short ones."""
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    return len(zlib.compress(raw, 1)) / len(raw)


def with_perplexity(base: DataFrame, folder: str | None) -> DataFrame:
    """_block, _at, doc_id, lang, symbols, perplexity, compressed of the texts that the model was trained with; null and empty
    texts have neither of the last two, and without a model no text has. A narrow step."""
    small_batches(base.sparkSession)
    if folder is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "compressed")]
        return base.select("_block", "_at", "doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("symbols"), *none)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        block = None
        for batch in batches:
            size, score, ratio = [], [], []
            for b, t in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                size.append(len(t or ""))
                ratio.append(compressed(t) if t else None)
                if not t:
                    score.append(None)
                    continue
                if b != block:
                    rows = read_block(f"{folder}/scores", b, ["key", "logp"])
                    keys, logp = (np.array(rows.column(c)) for c in ("key", "logp"))
                    order = np.argsort(keys)
                    keys, logp, block = keys[order], logp[order], b
                own = gram_keys(t)[1]
                where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                if (keys[where] != own).any():
                    raise ValueError("a text holds an n-gram that its block did not ask for")
                score.append(float(np.exp(-logp[where].mean(dtype=np.float64))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(size, pa.int64()), pa.array(score, pa.float64()), pa.array(ratio, pa.float64())], ["_block", "_at", "doc_id", "lang", "symbols", "perplexity", "compressed"])

    return base.select("_block", "_at", "doc_id", "lang", "text").mapInArrow(tidy(run), "_block long, _at long, doc_id long, lang string, symbols long, perplexity double, compressed double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents: those labelled with quality 1."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_trusted")).where("_trusted is not null").distinct()


@dataclass
class QualityModel:
    """folder: the trained tables. limits: lang, threshold (of perplexity), least (of compression), one row per language that
    has trusted texts. threshold, least: those over all trusted texts, for other languages and null. scores: see with_perplexity."""

    folder: str | None
    limits: DataFrame
    threshold: float | None
    least: float | None
    scores: DataFrame


def _limits(quantile: float, margin: float) -> list:
    high = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin
    low = F.percentile_approx("compressed", F.lit(REPEAT_QUANTILE), F.lit(10_000)) / margin
    return [high.alias("threshold"), low.alias("least")]


def _fit(placed: DataFrame, labels: DataFrame, text: str, id_col: str, lang: str, quantile: float, margin: float) -> QualityModel:
    field = lambda c: F.col(f"row.`{c}`")
    base = placed.select("_block", "_at", field(id_col).cast("long").alias("doc_id"), field(lang).cast("string").alias("lang"), field(text).alias("text"))
    trusted = write_table(trusted_ids(labels), "trusted")
    folder = train(base, trusted)
    scores = write_table(with_perplexity(base, folder), "perplexity")
    known = scores.where("perplexity is not null").join(trusted, F.col("doc_id") == F.col("_trusted"), "left_semi")
    limits = write_table(known.where("lang is not null").groupBy("lang").agg(*_limits(quantile, margin)), "limits")
    overall = known.agg(*_limits(quantile, margin)).first()
    return QualityModel(folder, limits, overall["threshold"], overall["least"], scores)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> QualityModel:
    """Train on the texts of all trusted documents, score all documents, and set limits per language.

    Languages without trusted texts, and null, have the limits over all trusted documents. No trusted text, or an empty
    table: no score and no limit, so nothing is rejected. Repeated rows count as often as they stand there.
    """
    return _fit(located(docs), labels, text, id_col, lang, quantile, margin)


def judge(model: QualityModel) -> DataFrame:
    """Scores with `threshold`, `least` and `kept`. Documents without perplexity are kept: nothing speaks against them."""
    out = model.scores.join(model.limits, "lang", "left")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(model.threshold).cast("double"))).withColumn("least", F.coalesce("least", F.lit(model.least).cast("double")))
    return out.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("compressed") >= F.col("least")), F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents that the model does not reject, with all their columns, whatever these are called. Texts stay where they are.

    Null and empty texts are kept; an empty table gives an empty result.
    """
    placed = located(docs)
    model = _fit(placed, labels, text, id_col, lang, QUANTILE, MARGIN)
    return with_marks(placed, judge(model).where("kept").select("_block", "_at")).select("row.*")
