"""Line runs, word runs and whitening against brute force and edge cases (null, empty, long, repeated, tied, extra columns)."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchforge.llm import line_runs, periodic_runs, queries, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, kept string, runs int, x string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, "extra", 7, "y") for i, t in texts], DOCS)


# -- lines


def line_texts():
    random.seed(11)
    common = ["Terms  of use", " terms  OF use\t", "\x0bTERMS  of use\r"]
    texts = []
    for i in range(60):
        lines = [f"line {random.randint(0, 40)}" for _ in range(random.randint(0, 12))]
        if i % 3 == 0:
            lines += random.choices(common, k=2) + ["", "  "]
        texts.append((i, "\n".join(lines)))
    texts += [(i % 4, "rare É\nrare é") for i in range(10)]  # rows of equal ids count; only A-Z are lowered
    return texts + [(None, None), (100, ""), (101, "\n"), (102, "x" * 300_000 + "\nline 1"), (103, "\n".join(f"n{i}" for i in range(40_000)))]


def lines_brute(texts, documents, points):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < points or counts[key(x)] < documents]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("documents,points", [(10, 1), (2, 7), (1, 1)])
def test_frequent_lines_against_brute_force(spark, tmp_path, documents, points):
    texts = line_texts()
    frame(spark, texts).repartition(7).write.parquet(f"{tmp_path}/docs")
    got = line_runs.without_frequent_lines(spark.read.parquet(f"{tmp_path}/docs"), documents, points, batches=5)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == lines_brute(texts, documents, points)


def test_frequent_lines_of_tables_that_are_no_files_or_empty(spark):
    texts = line_texts()
    got = line_runs.without_frequent_lines(frame(spark, texts), 10)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == lines_brute(texts, 10, 1)
    assert line_runs.without_frequent_lines(frame(spark, []), 10).count() == 0


def test_levels_hold_all_counts_and_outlive_the_session(spark, tmp_path):
    random.seed(2)
    path = f"file://{tmp_path}/index"
    index = line_runs.LineIndex(spark, path, settled=10, buckets=3, fanout=2, level_keys=20)
    counts = Counter()
    for _ in range(9):
        batch = [(random.randint(0, 60), random.choice([1, 2]), 1) for _ in range(40)]
        counts.update((a, b) for a, b, _ in batch)
        index.add(spark.createDataFrame(batch, "h1 long, h2 long, docs long"))
        sizes = [len(runs) for runs in index._levels()]
        assert sizes[0] < 2 and all(s <= 1 for s in sizes[1:])
    assert len(sizes) > 2
    index.close()
    again = line_runs.LineIndex(spark, path, settled=10, fanout=2, level_keys=20)
    assert again.buckets == 3
    for least in (1, 5, 10):
        assert {tuple(r) for r in again.frequent(least).collect()} == {k for k, n in counts.items() if n >= least}
    with pytest.raises(ValueError):
        again.frequent(11)
    again.close()


def test_runs_merge_without_a_shuffle(spark, tmp_path):
    index = line_runs.LineIndex(spark, f"file://{tmp_path}/index", settled=3, buckets=4)
    for k in range(2):
        index.add(spark.createDataFrame([(1, k, 1), (2, 2, 5)], "h1 long, h2 long, docs long"))
    runs = [r for level in index._levels() for r in level]
    plan = index._totals(runs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert {tuple(r) for r in index._read(runs).collect()} == {(1, 0, 1), (2, 2, 5), (1, 1, 1)}  # (2, 2) was settled and not added again
    index.close()


# -- words


def runs_brute(words, least):
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(least, 2 * q) and all(part[r:] != part[: length - r] for r in range(1, q)):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_brute(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_texts():
    random.seed(12)
    texts = []
    for i in range(150):
        w = [f"w{random.randint(0, random.choice([1, 3, 30]))}" for _ in range(random.randint(0, 60))]
        if i % 2:
            block = [f"b{random.randint(0, 5)}" for _ in range(random.randint(1, 8))]
            w += block * random.randint(1, 7) + block[: random.randint(0, len(block))] + w[:5]
        texts.append((i, random.choice([" ", "\n", "\t\x0b ", "  "]).join(w)))
    texts += [(200, None), (None, "a " * 30), (None, None), (201, ""), (202, " \n"), (203, "one " * 40), (3, texts[3][1]), (204, "a b " * 3000 + "c"), (205, " ".join(f"u{i}" for i in range(300_000)))]
    return texts


def test_word_runs_against_brute_force(spark):
    texts = [t for t in word_texts() if t[0] != 205]
    for least in (12, 5):
        got = periodic_runs.repeated_words(frame(spark, texts), least=least).collect()
        want = []
        for i, t in texts:
            w = WORDS.findall(t or "")
            runs = runs_brute(w, least) if i != 204 else [(0, 6000, 2)]
            want.append((i, len(w), runs, collapsed_brute(w, runs)))
        assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic_runs.repeated_words(frame(spark, [])).count() == 0


def test_query_of_word_runs_against_brute_force(spark, tmp_path):
    texts = word_texts()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_lyndon_runs(spark, str(tmp_path)).collect()
    want, planted = [], 0
    for i, t in texts:
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = runs_brute(w, 12) if i not in (204, 205) else [(0, 6000, 2)] if i == 204 else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed_brute(w, runs))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    assert planted > 5 and zlib.crc32(b"204") % 10 and zlib.crc32(b"205") % 10
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_lyndon_arrays_of_both_orders(letters):
    random.seed(letters)
    for _ in range(400):
        x = [random.randrange(letters) for _ in range(random.randint(1, 40))]
        for s in (x, [-c for c in x]):
            want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
            assert periodic_runs.lyndon_array(s) == want


# -- vectors


def whitened_brute(vectors, components, scale=64, offset=1_000_000):
    x = np.floor(scale * np.array(vectors, np.float64)).astype(np.int64) + offset
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums)) for r in x]
    return n, deviation, (x - sums / n) @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("rows,dims,components", [(400, 24, 16), (300, 6, 16), (12, 40, 8)])
def test_whitening_against_eigenvectors(spark, rows, dims, components):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((rows, dims)) * np.linspace(3, 0.3, dims)).astype(np.float32)
    vectors[rows // 2 :] = vectors[: rows - rows // 2]  # copies
    data = [(i, v.tolist(), 1, "z") for i, v in enumerate(vectors)]
    bad = [(900, None, 1, "z"), (901, [None] * dims, 1, "z"), (902, [float("nan")] * dims, 1, "z"), (903, [float("inf")] * dims, 1, "z"), (904, [1.0], 1, "z"), (905, [], 1, "z")]
    got = whitening.whitened(spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, n int, x string"), components).collect()
    n, deviation, want, explained = whitened_brute(vectors, components)
    m = min(components, dims, n - 1)
    assert len(got) == rows * m and {r.n for r in got} == {n}
    mine = np.zeros((rows, m))
    for r in got:
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        mine[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((mine * want[:, :m]).sum(axis=0))
    assert np.abs(mine * signs - want[:, :m]).max() < 1e-7


def test_whitening_of_few_equal_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"

    def of(rows):
        return whitening.whitened(spark.createDataFrame(rows, schema)).collect()

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and of([(1, [])]) == []
    line = of([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0])])  # variance in one direction only
    assert {r.component for r in line} == {1} and len(line) == 4 and abs(line[0].explained - 1) < 1e-12
    large = of([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])
    assert len(large) == 6 - 3 * (len(large) == 3) and {r.deviation for r in large if r.vec_id == 1} == {None}
    same = of([(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])  # equal eigenvalues
    assert {round(r.explained, 12) for r in same} == {0.5} and max(r.identity_error for r in same) < 1e-12
