"""The ten operators against brute force, round trips and edge cases (null, empty, long, repeated, tied, extra columns)."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash

from matchforge.llm import chat_format as chat
from matchforge.llm import components, exact_dedup, minmax_dedup, mixing, packing, quality_lm, token_shards, tokens, topk_search, toxicity, warc_zstd

SPACES = "[\\x20\\x09-\\x0D]"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row string, name int"


def edge_documents():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    base = random.choices(words, k=120)
    near = base[:]
    near[60] = "changed"
    other = base[:]
    for i in range(0, 120, 10):
        other[i] = f"edit{i}"
    texts = [" ".join(base), " ".join(base).upper(), " ".join(near), " ".join(other), None, "", " \t\n", "one", "one two", "one  two\n", "é ü ß", "x" * 20_000, " ".join(random.choices(words, k=9000)), " ".join(base), "one two three", "THREE two one"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(0, " ".join(base), "en", "s0"), (None, " ".join(base), "en", None), (None, None, None, None)]
    return [(*r, 0, 7, "extra", 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_documents(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def squeeze(t):
    return re.sub(SPACES, "", t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def test_exact_dedup_against_brute_force(docs, none):
    rows = [(r[0], r[1]) for r in edge_documents()]
    for block in (3, 4096):
        got = exact_dedup.exact_groups(docs, block_bytes=block).collect()
        want = []
        for i, t in rows:
            same = [(j, u) for j, u in rows if squeeze(u) == squeeze(t)]
            best = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
            want.append((i, best[0], len(same), hashlib.sha256(squeeze(t).encode()).hexdigest()))
        assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(repr, want))
        assert sum(r.kept for r in got) == len({squeeze(t) for _, t in rows})
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({squeeze(t) for _, t in rows})


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, none, words, percent):
    rows = [(r[0], shingles(r[1], words)) for r in edge_documents()]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(b)] = root(a)
    want = []
    for i, (doc_id, s) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        want.append((doc_id, len(s), min(ids, default=None)))
    got = minmax_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(repr, want))
    assert sum(r.kept for r in got) == len({root(i) for i in range(len(rows))})
    assert minmax_dedup.near_duplicates(none).count() == 0
    assert minmax_dedup.drop_near_copies(docs, words=words, percent=percent).columns == docs.columns


def test_words_are_told_apart():
    tied = ["a"]
    for _ in range(11):
        tied.append(tied[-1] + tied[-1].translate(str.maketrans("ab", "ba")))
    words = {w for t in tied for w in (t, t.translate(str.maketrans("ab", "ba")))} | {tied[-1][:i] + "x" + tied[-1][i + 1 :] for i in range(0, 2048, 97)} | {"aa", "aaa", "ab", "ba"}
    words = sorted(words)
    hashes = minmax_dedup.word_hashes((" \n" + " \t ".join(words) + "  ").encode())
    assert len(set(hashes.tolist())) == len(hashes) == len(words)
    assert minmax_dedup.word_hashes(" ".join(words).upper().encode()).tolist() == hashes.tolist() and len(minmax_dedup.word_hashes(b" \n ")) == 0
    long = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    factors = minmax_dedup._factors(5)
    want = [f(int(v) % 2**32 * x % 2**32 for v in long.tolist()) for x in factors.tolist() for f in (min, max)]
    assert minmax_dedup.min_max_signature(long, factors).tolist() == want


def test_linked_matrix_against_sets():
    random.seed(12)
    sets = [np.unique(np.array(random.choices(range(60), k=random.randint(1, 60)), np.uint64)) for _ in range(80)]
    for percent in (30, 80):
        got = minmax_dedup.linked_matrix(sets[:50], sets[30:], percent)
        assert got.tolist() == [[100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) for y in sets[30:]] for x in sets[:50]]


def test_large_near_group_with_a_common_passage(spark):
    random.seed(3)
    words = [f"v{i}" for i in range(5000)]
    base, passage = random.choices(words, k=100), random.choices(words, k=60)
    texts = []
    for i in range(150):
        t = base[:]
        for j in random.sample(range(100), random.choice([1, 2, 3, 4, 8])):
            t[j] = f"e{i}_{j}"
        texts.append(" ".join(t))
    texts += [" ".join(random.choices(words, k=40) + passage + random.choices(words, k=40)) for _ in range(150)]
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        old = label[:]
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    got = minmax_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(label))


def test_near_duplicates_of_a_whole_table_against_brute_force(spark):
    """Recall on all documents of sf0.01: every component of the exact links is found, and no other."""
    from matchforge.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, shingles(r.text, 3)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    by_size = sorted((r for r in rows if r[1]), key=lambda r: len(r[1]))
    label, links = {i: i for i, _ in rows}, []
    for i, (a, x) in enumerate(by_size):
        for b, y in by_size[i + 1 :]:
            if 100 * len(x) < 85 * len(y):
                break
            if 100 * len(x & y) >= 85 * len(x | y):
                links.append((a, b))
    for _ in links:
        old = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    got = {r.doc_id: r.component_id for r in queries.op6_minmax_dedup(spark, sf).collect()}
    assert len(links) > 50 and got == label


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 5), (7, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {100: 5, 5: 5, 7: 5}


def test_packing(docs, none):
    path = tokens.default_tokenizer()
    got = packing.pack_documents(docs, window=256, open_windows=4).collect()
    coder = tokens.encoder(path)
    want = {}
    for r in edge_documents():
        ids = np.array(coder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [tokens.END_ID], "<u4")
        want.setdefault(r[0], []).append(ids)
    by_sequence = {}
    for r in got:
        assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in want[r.doc_id])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    assert sum(r.length for r in got) == sum(len(w) for ws in want.values() for w in ws)
    assert packing.pack_documents(none).count() == 0


def test_chunked_ids_equal_whole_text_ids():
    coder = tokens.encoder(tokens.default_tokenizer())
    for t in ["Hello, WORLD! it's a don't test's 123abc", "é́ ñ İstanbul ΣΑΣ straße", "a\x1cb\xa0c d\x85e", "!!! ### $$$%%% x_y-z foo.bar", "日本語 テキスト 👍🏽ok", "''' 're we're", "", "  ", "ﬁ ligature Å Å", "<|startoftext|> a<|endoftext|>b"]:
        assert np.frombuffer(coder.encode(t.encode()), "<u2").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_chunked_ids_of_superscripts_fractions_and_every_latin_character():
    coder = tokens.ChunkEncoder(tokens.default_tokenizer())
    for t in ["m² cm² co² 10m³ x¹ 1½ ½ tasse¼ a¾b m²!", *(f"{a}{chr(c)}{b}" for c in range(0x21, 0x250) for a, b in (("", ""), ("a", "b"), ("ab", "!")))]:
        assert np.frombuffer(coder.encode(t.encode()), "<u2").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_open_windows_hold_a_bound():
    held, done = packing.OpenWindows(10, 3), []
    for n in (6, 7, 8, 4, 9, 10, 3):
        done += held.place(n, [(n,)])
        assert len(held.open) <= 3
    assert [(6,), (4,)] in done and [(10,)] in done


def test_shards_round_trip_and_resume(docs, none):
    shards = token_shards.write_shards(docs, sequence=128, shard_sequences=10)
    rows = sorted(token_shards.read_shards(shards).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(shards.total)) and sorted(r.sequence for r in rows) == list(range(shards.total))
    coder = tokens.encoder(tokens.default_tokenizer())
    whole = b"".join(r.ids for r in sorted(rows, key=lambda r: r.sequence))
    end = np.array([tokens.END_ID], "<u2").tobytes()
    order = sorted(((r[0] is not None, r[0] or 0, xxhash.xxh3_128_digest((r[1] or "").encode()), r[1] or "") for r in edge_documents()))
    assert whole == b"".join(coder.encode(text.encode()) + end for *_, text in order)
    assert all(r.slot == token_shards.feistel(np.array([r.sequence]), shards.total, shards.key)[0] and r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in rows)
    again = token_shards.write_shards(docs.repartition(7), sequence=128, shard_sequences=10)
    assert {r.slot: r.ids for r in token_shards.read_shards(again).collect()} == {r.slot: r.ids for r in rows}
    later = sorted(r.slot for r in token_shards.read_shards(shards, 17).collect())
    assert later == list(range(17, shards.total)) and shards.place(17) == (1, 7 * shards.stride)
    assert token_shards.read_shards(token_shards.write_shards(none)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = token_shards.feistel(x, n, 42)
    assert sorted(y.tolist()) == x.tolist() and token_shards.feistel(y, n, 42, inverse=True).tolist() == x.tolist()


def test_warc_round_trip(spark):
    long_page = "<p>" + "ä" * 3000
    rows = [(1, "u1", long_page), (5, "u5", long_page), (3, None, long_page), (2, "u2", "short"), (4, "u4", "short"), (6, "u6", None), (None, "n", long_page), (7, "x: y", "z" * 100_000), (8, "a\r\nWARC-Type: metadata\r\n\r\nb%20", "cut"), (9, " %41\x00\x85", "ends"), (10, "http://e.org/%0D?a=b c#d", "plain")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, sha1 string, n int")
    manifest = warc_zstd.write_archives(pages)
    got = {r.record_id: r for r in warc_zstd.read_archives(manifest).collect()}
    assert len(got) == 11 and manifest.agg({"records": "sum"}).first()[0] == 11
    for page_id, url, html in rows:
        assert got[f"urn:page:{'' if page_id is None else page_id}"].uri == (url or "")
        r = got[f"urn:page:{'' if page_id is None else page_id}"]
        data = (html or "").encode()
        again = page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", "urn:page:5") if again else ("response", None))
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest() and (again or r.payload == data)
    assert warc_zstd.write_archives(pages.where("false")).count() == 0


def test_warc_reader_finds_damage():
    import io
    import struct

    import zstandard

    good = warc_zstd.record_bytes("urn:page:1", "u", "response", b"hi", 2, hashlib.sha1(b"hi").hexdigest(), None)
    assert warc_zstd.parse_record(good)["payload"] == b"hi"
    for bad in (good.replace(b"hi", b"ho"), good[:-2], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc_zstd.parse_record(bad)
    words = b"some dictionary content that is long enough"
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    head = struct.pack("<II", warc_zstd.DICTIONARY_MAGIC, len(words)) + words
    assert len(list(warc_zstd.archive_records(io.BytesIO(head + coder.compress(good) * 2)))) == 2
    for data in (head + coder.compress(good)[:-3], coder.compress(good), head[:20]):
        with pytest.raises(ValueError):
            list(warc_zstd.archive_records(io.BytesIO(data)))


def test_chat_round_trip_and_mask(spark):
    random.seed(1)
    nasty = ["\\### Assistant: </turn> ok", "### user: a", "</turn>\n### x: y </turn>\n", "\\", "", None, "a\\\\### b", " </turn>", "ordinary text " * 40, "é👍"]
    rows = [(c, t, role, random.choice(nasty)) for c in (1, 2, None) for t, role in enumerate(["system"] * (c == 1) + ["user", "assistant"] * 12)]
    rows += [(3, 0, "user", "x"), (3, 0, "assistant", "x"), (3, None, None, "y"), (3, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(df, budget=200, history=2)
    got = {r.conv_id: r for r in chat.read_digests(windows).collect()}
    for c in (1, 2, None, 3):
        mine = sorted(((t is not None, t or 0, role or "", text or "") for d, t, role, text in rows if d == c))
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in mine).encode()).hexdigest()
        target = "".join(text for _, _, role, text in mine if role == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    first = [r for r in windows.collect() if r.conv_id == 1]
    assert len(first) > 1 and all(next(chat.parse_turns(r.formatted))[0] == "system" for r in first)
    assert all(r.tokens <= 200 or sum(r.new_turns) == 1 for r in first)
    coder = tokens.encoder(tokens.default_tokenizer())
    assert all(r.tokens == len(coder.tokenizer.encode(r.formatted, add_special_tokens=False).ids) for r in windows.collect())
    large = spark.createDataFrame([(1, 0, "system", "rule " * 500)] + [(1, i, "user", f"turn {i} " * 10) for i in range(1, 40)], "conv_id long, turn long, role string, text string")
    later = chat.format_conversations(large, budget=200, history=2).where("window > 0").collect()
    assert later and all(r.tokens <= 200 and "### system" not in r.formatted for r in later)
    assert chat.read_digests(chat.format_conversations(large, budget=200)).first().n_turns == 40
    assert chat.read_digests(chat.format_conversations(df.where("false"))).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 13)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 320)] + [(400, None), (450, [float("nan")] * 13), (500, [None] * 13), (550, [1.0, 2.0]), (600, [3.0, 4.0]), (50, rows[7][1]), (650, []), (None, rows[1][1])]
    rows += [(i, [x * 1e30 if i % 2 else float(10**16) + x for x in rows[i % 7][1]]) for i in range(700, 712)] + [(750, [1e300] * 13), (751, [-1e300] * 13), (752, [1e9] * 13)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % 50 == 0:
            s = sorted(((-min(2**63 - 1, max(-(2**63), sum(p * r for p, r in zip(x, y)))), i is None, i or 0) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x)))[:5]
            want += [(q, k + 1, None if none else i, -score) for k, (score, none, i) in enumerate(s)]
    got = topk_search.top_k(df, query_block=3, row_block=40)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert topk_search.top_k(df.where("false")).count() == 0


def test_mixing_targets_and_limits(spark, docs, none):
    random.seed(2)
    rows = [(i, " ".join(["w"] * random.randint(0, 400)), random.choice(["a", "b", "b", "b", "b", None])) for i in range(400)] + [(900, "w", "tiny"), (901, None, "void")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, place int")
    got = mixing.mix_sources(df, block_words=64).documents.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 3 * sizes[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    for s in order:
        target = 3 * sizes[s] if s in capped else level * weight[s]
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target) and r.taken <= 3 * r.size for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target, abs=1)
    again = mixing.mix_sources(df, block_words=64).documents.collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(none).documents.count() == 0
    assert mixing.mix_sources(docs).documents.count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(none).count() == 0
    whole = mixing.mixed_documents(df).collect()
    for s in order:
        words = sum(len(r.text.split()) for r in whole if r.source == s)
        assert abs(words - sum(r.taken for r in got if r.source == s)) <= 200, s


def test_schedule_spreads_sources(spark):
    sources = spark.createDataFrame([(0, 700, 0), (1, 200, 700), (2, 100, 900)], "place int, slots long, first_slot long")
    rows = mixing.golden_slots(sources, 1000).orderBy("slot").collect()
    assert sorted((r.place, r["rank"]) for r in rows) == [(p, i) for p, n in ((0, 700), (1, 200), (2, 100)) for i in range(n)]
    for at in range(0, 900, 100):
        assert abs(sum(r.place == 0 for r in rows[at : at + 100]) - 70) <= 5


def plain_kneser_ney(texts, order=4):
    """p(context, character) and the alphabet: interpolated modified Kneser-Ney over code points, written out plainly."""
    counts = {order: {}}
    for t in texts:
        padded = "\n" * (order - 1) + t
        for i in range(len(t)):
            g = padded[i : i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discounts, alphabet = {}, sorted(counts[1])
    for n, table in counts.items():
        of = [sum(c == k for c in table.values()) for k in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        discounts[n] = [0.0, *(min(k, max(0.0, k - (k + 1) * y * of[k + 1] / of[k] if of[k] and of[k + 1] else 0.5 * k)) for k in (1, 2, 3))]
    totals = {n: {} for n in counts}
    for n, table in counts.items():
        for g, c in table.items():
            total = totals[n].setdefault(g[:-1], [0, 0.0])
            total[0] += c
            total[1] += min(discounts[n][min(c, 3)], c)

    def p(context, c):
        n = len(context) + 1
        low = p(context[1:], c) if context else 1 / (len(alphabet) + 1)
        if context not in totals[n]:
            return low
        total, held = totals[n][context]
        count = counts[n].get(context + c, 0)
        return (count - min(discounts[n][min(count, 3)], count)) / total + held / total * low

    return p, alphabet


def test_kneser_ney_sums_to_one_and_rejects_noise(spark, docs, none):
    random.seed(4)
    good = [(i, " ".join(random.choices(["the", "cat", "sat", "on", "mats", "and", "slept"], k=60)) + ".", "en") for i in range(120)]
    bad = [(1000 + i, "".join(random.choices("QZXJ#@!%&0123456789", k=300)), "en") for i in range(10)] + [(2000, None, "en"), (2001, "", None)]
    df = spark.createDataFrame([(*r, "s") for r in good + bad], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    model = quality_lm.fit(df, labels)
    p, alphabet = plain_kneser_ney([t for i, t, _ in good if i < 60])
    for context in ("\n\n\n", "the", " ca", "zzz", "on "):
        assert sum(p(context, c) for c in alphabet) + p(context, "\0") == pytest.approx(1)
    for r, (i, t, _) in zip(model.scores.orderBy("doc_id").collect(), good[:50]):
        padded = "\n\n\n" + t
        assert r.doc_id == i and r.perplexity == pytest.approx(math.exp(-sum(math.log(p(padded[k : k + 3], padded[k + 3])) for k in range(len(t))) / len(t)), rel=1e-5)
    kept = {r.doc_id for r in quality_lm.judge(model).where("kept").collect()}
    assert kept == {i for i in range(120)} | {2000, 2001}
    out = quality_lm.keep_good(df, labels)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    assert quality_lm.keep_good(docs, labels.where("false")).count() == docs.count()
    assert quality_lm.keep_good(none, labels).count() == 0


def test_model_tells_texts_of_other_scripts_from_junk(spark):
    random.seed(8)
    scripts = {"el": "καλημέρα κόσμε πώς είσαι σήμερα φίλε".split(), "ja": "今日は 天気が いいですね 東京の 朝は 静かです".split()}
    rows = [(i * 1000 + j, " ".join(random.choices(words, k=40)), lang) for i, (lang, words) in enumerate(scripts.items()) for j in range(80)]
    junk = [(9000 + i * 100 + j, "".join(random.choices(sorted(set("".join(words))), k=200)), lang) for i, (lang, words) in enumerate(scripts.items()) for j in range(20)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    model = quality_lm.fit(df, spark.createDataFrame([(r[0], 1) for r in rows if r[0] % 1000 < 60], "doc_id long, quality int"))
    kept = {r.doc_id for r in quality_lm.judge(model).where("kept").collect()}
    assert kept == {r[0] for r in rows}
    seen = {r.gram for r in spark.read.parquet(f"{model.folder}/grams").where("n = 4").collect()}
    text = ["\n\n\n" + r[1] for r in rows if r[0] % 1000 < 60]
    assert seen == {t[i : i + 4] for t in text for i in range(len(t) - 3)}


def test_repeated_words_and_phrases_are_rejected(spark):
    random.seed(9)
    words = ["der", "die", "und", *("".join(random.choices("abcdefghilmnorstu", k=random.randint(3, 9))) for _ in range(300))]
    good = [(i, " ".join(random.choices(words, [40] * 3 + [1] * 300, k=120)), "de") for i in range(150)]
    bad = [(1000, "Der " * 200, "de"), (1001, "der " * 200, "de"), (1002, (" ".join(random.choices(words, k=9)) + ". ") * 20, "de"), (1003, "und die und " * 60, "xx")]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert {r.doc_id for r in quality_lm.keep_good(df, labels).collect()} == {r[0] for r in good}


def test_toxicity_held_out(spark, docs, none):
    random.seed(6)
    plain, rude = [f"word{i}" for i in range(300)], ["rotten", "vile", "nastyish", "nastyful", "nastyous"]
    rows = [(i, " ".join(random.choices(plain, k=40) + (random.choices(rude, k=3) if i % 5 == 0 else []))) for i in range(600)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out) >= 0.98 * sum(r.held_out for r in got)
    model = toxicity.train(none, labels.where("false"))
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n = 8000
    y = rng.random(n) < 0.3

    def vote(right, silent=0.0):
        v = np.where(rng.random(n) < right, y, ~y).astype(np.int8)
        v[rng.random(n) < silent] = -1
        return v

    rights = [0.9, 0.85, 0.8, 0.75, 0.85, 0.8, 0.9]
    columns = [vote(x, silent) for x, silent in zip(rights, (0, 0.3, 0, 0.5, 0, 0, 0.2))]
    copy = np.where(rng.random(n) < 0.8, columns[2], vote(0.8)).astype(np.int8)
    post, accuracy, correlation = toxicity.label_model(np.stack([*columns, copy, np.full(n, -1, np.int8)], axis=1), 0.3)
    assert np.abs(accuracy - [*rights, 0.8, 0.5]).max() < 0.06
    assert correlation[2, 7] > 0.6 and np.abs(correlation[0, [1, 3, 4, 5, 6]]).max() < 0.2
    assert ((post > 0.5) == y).mean() > 0.94


def test_voters_of_three_kinds_can_say_yes_no_and_nothing():
    quiet, loud = [0.0] * 4, [9.0, 0.0, 0.0, 0.0]
    rows = [(1, [1], [11], loud)] + [(0, [2], [12], quiet)] * 300 + [(0, [], [], [0.5, 0.0, 0.0, 0.0])] * 4
    votes = toxicity.term_votes(rows, [1], [2], [11])
    words, patterns = votes[:, : toxicity.TOXIC_VOTERS + toxicity.CLEAN_VOTERS], votes[:, toxicity.TOXIC_VOTERS + toxicity.CLEAN_VOTERS : -4]
    assert words[0].max() == 1 and (words[1] >= 0).sum() == 1 and words[1].max() == 0 and (words[301] == -1).all()
    assert patterns[0].max() == 1 and (patterns[1:] == -1).all() and votes[0, -4] == 1 and votes[1, -4] == 0 and votes[301, -4] == -1 and (votes[:, -3:] == 0).all()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage's rows on a small fixture: what is rejected, which copy stays, the mix, and every packed piece."""
    import corpus_pipeline

    random.seed(21)
    words = ["".join(random.choices("abcdefghilmnorstu", k=random.randint(3, 9))) for _ in range(400)]
    text = lambda n=90: " ".join(random.choices(words, [30] * 5 + [1] * 395, k=n))
    rows = [(i, text(), "en", random.choice("ab")) for i in range(160)]
    edited = rows[7][1].split()
    edited[40] = "edited"
    rows += [(200, rows[3][1], "en", "a"), (201, rows[3][1] + " ", "en", "b"), (202, " ".join(edited), "en", "a"), (203, "zq" * 150, "en", "a"), (204, None, "en", "b"), (205, "", "en", None), (206, "word " * 150, "en", "b")]
    rows = [(*r, len(r[1] or ""), "kept", 5) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _block string, copies int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    spaces = lambda t: re.sub(SPACES, "", t or "")

    good = stage["quality"](spark, df, str(tmp_path)).collect()
    assert {r.doc_id for r in good} == {r[0] for r in rows} - {203, 206} and all(r._block == "kept" and r.copies == 5 for r in good)

    exact = stage["exact_dedup"](spark, spark.createDataFrame(good, df.schema), str(tmp_path)).collect()
    best = {}
    for r in good:
        k = (-len(r.text or ""), r.doc_id)
        best[spaces(r.text)] = min(best.get(spaces(r.text), k), k)
    assert sorted(r.doc_id for r in exact) == sorted(i for _, i in best.values())

    near = stage["near_dedup"](spark, spark.createDataFrame(exact, df.schema), str(tmp_path)).collect()
    sets, group = {r.doc_id: shingles(r.text, 5) for r in exact}, {r.doc_id: r.doc_id for r in exact}
    for _ in exact:
        for a, b in combinations(sorted(sets), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
        if all(group[g] == g for g in group.values()):
            break
    assert sorted(r.doc_id for r in near) == sorted(set(group.values())) and 202 not in {r.doc_id for r in near}

    mixed = stage["mixing"](spark, spark.createDataFrame(near, df.schema), str(tmp_path)).collect()
    sizes = {s: sum(len((r.text or "").split()) for r in near if r.source == s) for s in ("a", "b", None)}
    total = sum(sizes.values())
    targets = {"a": min(3 * sizes["a"], total / 3), "b": min(3 * sizes["b"], total * 2 / 3)}  # null holds no words and stops at 0
    for s, target in targets.items():
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - target) <= 90
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and all(r._block == "kept" for r in mixed)

    packed = stage["packing"](spark, spark.createDataFrame(mixed, df.schema), str(tmp_path)).collect()
    coder = tokens.encoder(tokens.default_tokenizer())
    ids = {r.doc_id: np.array(coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [tokens.END_ID], "<u4") for r in mixed}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == sorted((r.doc_id, at, len(ids[r.doc_id][at : at + 4096]), zlib.crc32(ids[r.doc_id][at : at + 4096].tobytes()), len(ids[r.doc_id])) for r in mixed for at in range(0, len(ids[r.doc_id]), 4096))


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name in ("exact_dedup", "near_dedup"):
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[5] > 0


def test_turns_of_fifty_million_characters_are_parsed_in_little_memory():
    import tracemalloc

    text = ("\\ ### </turn> " + "x" * 86) * 500_000
    formatted = chat.format_turn("user", text)[0] + chat.format_turn("assistant", "")[0]
    assert len(text) == 50_000_000
    tracemalloc.start()
    turns = [(role, len(t), t == text) for role, t, _, _ in chat.parse_turns(formatted)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert turns == [("user", len(text), True), ("assistant", 0, False)] and peak < 500_000_000
    with pytest.raises(ValueError):
        list(chat.parse_turns("### user: never ends"))
