"""Toxicity by weak supervision.

From a bounded sample of labelled training rows, terms that go with toxicity or with its absence are mined. They make voters
of three kinds: lexicon voters hold words (toxic ones vote 1, clean ones vote 0), pattern voters hold word beginnings, and
style voters watch shouting, runs of marks, masked and stretched words; a voter with nothing to say abstains. Terms of like
strength share a voter, so voters differ in accuracy. A generative label model estimates by expectation maximisation how often
each voter is right, and from the covariance of votes given the label how much voters repeat each other; correlated voters
count less. Its posterior labels train a linear classifier over the mined terms, which scores every whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import small_batches, tidy, write_table

TRAIN_ROWS = 20_000
MIN_DOCUMENTS = 3
#: Least log-likelihood ratio of a term's counts in toxic and other rows; least share of toxic rows among a toxic term's rows, and
#: largest one among a clean term's rows, as a part of the share in all rows.
MIN_RATIO, MIN_SHARE, CLEAN_PART = 12.0, 0.9, 0.1
TOXIC_VOTERS, CLEAN_VOTERS, PATTERN_VOTERS = 10, 4, 6
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_STYLES = [re.compile(r"\b[^\W\d_a-z]{3,}\b"), re.compile(r"[!?]{2,}"), re.compile(r"[^\W\d_][*@$#]+[^\W\d_]"), re.compile(r"([^\W\d_])\1\1")]
CACHE_WORDS = 2_000_000


def _signed(name: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(name)
    return h - (1 << 64) if h >= 1 << 63 else h


def term_hashes(word: str) -> tuple[int, ...]:
    """Signed 64-bit hashes of the terms of a word: the word first, then its beginnings."""
    return tuple(map(_signed, [f"w:{word}", *(f"p{k}:{word[:k]}" for k in PREFIXES)]))


def style_counts(text: str | None) -> list[float]:
    """Shouted words, runs of marks, masked words and stretched words, by a thousand characters."""
    t = text or ""
    return [1000.0 * sum(1 for _ in p.finditer(t)) / max(1000, len(t)) for p in _STYLES]


def distinct_words(text: str | None) -> set:
    return set(_WORD.findall((text or "").lower()))


def label_model(votes, prior: float, rounds: int = 60):
    """(posterior of each row, accuracies, correlations) of voters with votes 1, 0 and -1 (none), by EM.

    Each voter has a table P(vote | label). At first voters count as independent given the label; from the labels found so, the
    correlation of voters given the label is measured. In further rounds a vote's evidence is divided by the sum of its voter's
    absolute correlations with those that vote in the same row, and that of saying nothing by the sum over all voters. The
    share of labels is held. An accuracy is the probability that a vote that was given is right (one half if none was).
    """
    import numpy as np

    n, m = votes.shape
    hits = np.stack([(votes == v).astype(np.float64) for v in (1, 0, -1)])  # kind, row, voter
    signed, voted = hits[0] - hits[1], hits[0] + hits[1]
    # Start: voters are better than chance, and what a voter says of most rows says little.
    score = (signed - signed.mean(0)).sum(1)
    post = np.where(score > np.quantile(score, 1 - prior), 0.9, prior * 0.1)
    share = float(np.clip(prior, 1e-3, 1 - 1e-3))
    weights, quiet, correlation = np.ones((n, m)), np.ones(m), np.eye(m)
    for stage in range(2):
        for _ in range(rounds):
            tables = np.stack([(w[None, :, None] * hits).sum(1) + 0.1 for w in (1 - post, post)])
            tables /= tables.sum(1, keepdims=True)  # label, kind, voter
            says = np.log(tables[1]) - np.log(tables[0])
            evidence = np.log(share / (1 - share)) + (weights * (hits[0] * says[0] + hits[1] * says[1])).sum(1) + (quiet * hits[2] * says[2]).sum(1)
            new = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
            moved, post = np.abs(new - post).max(), new
            if moved < 1e-6:
                break
        if stage == 0:
            expected = tables[:, 0] - tables[:, 1]
            residual = signed - (post[:, None] * expected[1] + (1 - post[:, None]) * expected[0])
            spread = np.sqrt((residual**2).mean(0)) + 1e-6
            correlation = residual.T @ residual / n / np.outer(spread, spread)
            np.fill_diagonal(correlation, 1.0)
            strong = np.where(np.abs(correlation) > 0.1, np.abs(correlation), 0)
            weights, quiet = 1 / np.maximum(1.0, voted @ strong), 1 / strong.sum(0)
    right, given = share * tables[1, 0] + (1 - share) * tables[0, 1], share * (1 - tables[1, 2]) + (1 - share) * (1 - tables[0, 2])
    return post, np.where(voted.any(0), right / np.maximum(given, 1e-12), 0.5), correlation


def _seats(hashes: list, first: int, voters: int) -> dict:
    """Voter of each term: `hashes` come strongest first; voters hold one, two, four and so on of them, the last all others."""
    return {h: first + min(voters - 1, (i + 1).bit_length() - 1) for i, h in enumerate(hashes)}


def term_votes(rows: list, toxic: list, clean: list, patterns: list):
    """Votes (rows x voters) of the three kinds of voters. A row is (label, word hashes, beginning hashes, style counts)."""
    import numpy as np

    votes = np.full((len(rows), TOXIC_VOTERS + CLEAN_VOTERS + PATTERN_VOTERS + len(_STYLES)), -1, np.int8)
    words = _seats(toxic, 0, TOXIC_VOTERS)
    calm = _seats(clean, TOXIC_VOTERS, CLEAN_VOTERS)
    starts = _seats(patterns, TOXIC_VOTERS + CLEAN_VOTERS, PATTERN_VOTERS)
    styles = np.array([r[3] for r in rows])
    # Style voters: loud beyond nearly all rows that are labelled clean says 1, none at all says 0.
    quiet = styles[np.array([r[0] for r in rows]) == 0]
    loud = np.quantile(quiet, 0.995, axis=0) if len(quiet) else np.full(len(_STYLES), np.inf)
    votes[:, -len(_STYLES) :] = np.where(styles > np.maximum(loud, 1e-9), 1, np.where(styles == 0, 0, -1))
    for i, (_, w, p, _) in enumerate(rows):
        for seats, terms, vote in ((calm, w, 0), (words, w, 1), (starts, p, 1)):
            for t in terms:
                if t in seats:
                    votes[i, seats[t]] = vote
    return votes


def fit_terms(rows: list, toxic: list, clean: list, patterns: list) -> tuple[float, dict]:
    """(bias, {term hash: weight}) from rows of (label, word hashes, beginning hashes, style counts); the terms of each kind
    come strongest first. The classifier learns the label model's posterior labels, not the given ones."""
    import numpy as np

    n1 = sum(r[0] for r in rows)
    if not rows or not toxic + patterns or not n1:
        return float(np.log((n1 + 0.5) / (len(rows) - n1 + 0.5))) - 1.0, {}
    post, _, _ = label_model(term_votes(rows, toxic, clean, patterns), float(n1 / len(rows)))
    strong = np.array(toxic + patterns + clean, np.int64)
    rank = np.argsort(strong)
    held = [np.concatenate((r[1], r[2])).astype(np.int64) for r in rows]
    doc, all_ = np.repeat(np.arange(len(rows)), [len(h) for h in held]), np.concatenate(held)
    place = np.minimum(np.searchsorted(strong[rank], all_), len(strong) - 1)
    known = strong[rank][place] == all_
    doc, full = doc[known], rank[place[known]]

    # Logistic regression on posterior labels, full gradient steps with per-weight step sizes.
    weight, bias, k = np.zeros(len(strong)), float(np.log((post.sum() + 0.5) / (len(rows) - post.sum() + 0.5))), len(rows)
    m1, m2, b1, b2 = np.zeros(len(strong)), np.zeros(len(strong)), 0.0, 0.0
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, weight[full], k), -30, 30)))
        error = p - post
        g, gb = np.bincount(full, error[doc], len(strong)) / k + 1e-4 * weight, error.mean()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weight -= 0.05 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-6)
        bias -= 0.05 * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-6)
    return float(bias), {int(t): float(w) for t, w in zip(strong, weight)}


def held_out(doc_id):
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[float, dict]:
    """Learn from at most `rows` labelled rows that are not held out (those of the smallest id hashes).

    The sample is bounded by `rows`, so it may be broadcast, and one task learns from it. Ids with several labels are toxic if
    one says so; null ids and labels are left out; repeated documents count as often as they stand there. Terms are counted by
    Spark; all that are strong enough are used. An empty table, and labels of one kind only, give a model that finds nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = usable.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id")
    chosen = write_table(chosen.select("_id", "_toxic", "text"), "toxicity-sample")

    def terms(wanted=None):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            cache: dict = {}
            for batch in batches:
                words, starts, styles = [], [], []
                for t in batch.column(2).to_pylist():
                    found = [], []
                    for w in sorted(distinct_words(t)):
                        if w not in cache:
                            if len(cache) > CACHE_WORDS:
                                cache.clear()
                            h = term_hashes(w)
                            keep = lambda x: wanted is None or x in wanted
                            cache[w] = [x for x in h[:1] if keep(x)], [x for x in h[1:] if keep(x)]
                        found[0].extend(cache[w][0])
                        found[1].extend(cache[w][1])
                    made = [np.array(f, np.int64) for f in found]
                    words.append(made[0])
                    starts.append(made[1] if wanted is not None else np.unique(made[1]))
                    styles.append(style_counts(t))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (words, starts)), pa.array(styles, pa.list_(pa.float64()))], ["_id", "_toxic", "words", "starts", "styles"])

        return chosen.mapInArrow(tidy(run), "_id long, _toxic int, words array<long>, starts array<long>, styles array<double>")

    n, n1 = chosen.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    share = n1 / n if n else 0.0
    kinds = F.concat(*[F.transform(c, lambda h: F.struct(F.lit(k).alias("kind"), h.alias("term"))) for k, c in enumerate(("words", "starts"))])  # noqa: B023
    counted = terms().select("_toxic", F.inline(kinds)).groupBy("kind", "term").agg(F.sum("_toxic").alias("k"), F.count("*").alias("seen")).where(F.col("seen") >= MIN_DOCUMENTS)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("seen") * F.lit(max(p, 1e-12))))).otherwise(0.0)
    ratio = 2 * (part(F.col("k"), share) + part(F.col("seen") - F.col("k"), 1 - share))
    rated = counted.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    toxic = F.col("k") >= MIN_SHARE * F.col("seen")
    clean = (F.col("kind") == 0) & (F.col("k") <= CLEAN_PART * share * F.col("seen"))
    found = rated.withColumn("side", F.when(toxic, 1).when(clean, 0)).where("side is not null").orderBy(F.desc("ratio"), "term").collect()
    pick = lambda kind, side: [r["term"] for r in found if (r["kind"], r["side"]) == (kind, side)]
    groups = pick(0, 1), pick(0, 0), pick(1, 1)

    def learn(batches):
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            held += [(i, y, np.array(w, np.int64), np.array(p, np.int64), s) for i, y, w, p, s in zip(*(batch.column(c).to_pylist() for c in range(5)))]
        held.sort(key=lambda r: (r[0], len(r[2]), len(r[3])))
        bias, weights = fit_terms([r[1:] for r in held], *groups)
        yield pa.RecordBatch.from_arrays([pa.array([None, *weights], pa.int64()), pa.array([bias, *weights.values()], pa.float64())], ["term", "weight"])

    learned = terms(frozenset(t for g in groups for t in g)).repartition(1).mapInArrow(tidy(learn), "term long, weight double").collect()
    return next((r["weight"] for r in learned if r["term"] is None), -5.0), {r["term"]: r["weight"] for r in learned if r["term"] is not None}


def score(docs: DataFrame, model: tuple[float, dict], text: str = "text", id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text; null and empty texts get the score of no term.

    A word counts once however often it stands in a text; repeated rows are scored alike; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    bias, weights = model

    class Weights(dict):
        def __missing__(self, word):
            if len(self) > CACHE_WORDS:
                self.clear()
            w = self[word] = sum(weights.get(h, 0.0) for h in term_hashes(word))
            return w

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = Weights()
        for batch in batches:
            z = np.array([bias + sum(map(cache.__getitem__, distinct_words(t))) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
