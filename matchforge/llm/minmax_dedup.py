"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

Under each permutation both the smallest and the largest value are kept, so a signature of 2k values costs k hash
evaluations per shingle. Bands of signature values deal documents into buckets; links are looked for inside buckets
and confirmed by comparing whole shingle sets.

Skew and repeats: documents with one and the same shingle set are one node (named by a digest of the set) in all later
steps, and buckets that hold one node only are left behind. A bucket does not pair its members. First each member is
compared with the bucket's hub, the member that shares most buckets with others; a hub meets a member once, however many
buckets they share, and members linked to it need nothing more. Then, hub by hub, the members that are not in the hub's
component are compared with members of other components, in blocks of bounded bytes inside tasks: the Jaccard distance is
a metric, so only members at nearly the same distance from the hub meet; the sizes of all intersections of two blocks
come from products of their incidence matrices, exactly; and a block gives back a spanning forest of components only, at
most one link per member. So no bucket is cut or left out, pairs never become rows, and no task holds more than two blocks.

Texts are never shuffled: a text whose set is needed is read again where it stands (see with_marks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import discard, located, small_batches, tidy, with_marks, write_table
from matchforge.llm.components import components

BANDS, BAND_ROWS = 48, 7
#: Members and bytes of shingle sets that one block holds, and shingles that one strip of an incidence matrix has.
BLOCK, BLOCK_BYTES, STRIP = 2048, 8_000_000, 2048
#: Letters of a word that the table of word_hashes covers; longer words are hashed one by one.
LONGEST = 64


def word_hashes(text: bytes):
    """64-bit hash of each maximal run of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased.

    A word's hash is the sum of random numbers, one for each byte at its place in the word. Two different words of one
    length have equal sums with a chance of 2^-64, whatever they look like.
    """
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    table, space = _table()
    ends = np.concatenate((np.flatnonzero(space[raw]), [len(raw)]))
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # White space after a word counts as part of it here; its numbers are 0.
    raw = raw[starts[0] :]
    first = starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.concatenate((first, [len(raw)]))))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(table[np.minimum(place, LONGEST - 1) << 8 | raw], first)
        for i in np.flatnonzero(lengths > LONGEST):
            sums[i] = _long_word(text[starts[i] : starts[i] + lengths[i]])
        return mix(sums + lengths.astype(np.uint64))


_TABLE: list = []


def _table():
    """(a random number for every place and byte of a word, which bytes are white space). Capitals have the numbers of small letters."""
    import numpy as np

    if not _TABLE:
        table = np.random.default_rng(20240917).integers(0, 1 << 64, (LONGEST, 256), dtype=np.uint64)
        table[:, 65:91] = table[:, 97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        table[:, space] = 0
        _TABLE[:] = [table.ravel(), space]
    return _TABLE


def _long_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.lower(), seed=20240917)


def mix(x):
    """Bijection of 64-bit numbers that spreads every bit."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, words: int):
    """Sorted distinct 64-bit hashes of the shingles of `words` words; fewer words make one shingle; no words make none."""
    import numpy as np

    w = word_hashes(text)
    if len(w) == 0:
        return w
    k = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def min_max_signature(hashes, factors):
    """[min, max] under each permutation x -> x * odd of 32-bit numbers, as one array of 2 * len(factors) numbers."""
    import numpy as np

    low, out = hashes.astype(np.uint32), np.empty((len(factors), 2), np.uint32)
    out[:, 0], out[:, 1] = np.iinfo(np.uint32).max, 0
    for at in range(0, len(low), 2048):
        h = np.multiply.outer(factors, low[at : at + 2048])
        np.minimum(out[:, 0], h.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], h.max(axis=1), out=out[:, 1])
    return out.ravel()


def _factors(n: int):
    import numpy as np

    return (np.random.default_rng(8191).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


def signatures(docs: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """_block, _at, doc_id, n_shingles, node (digest of the shingle set) and band values of (_block, _at, doc_id, content).

    Texts without words have no node and no bands."""
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        factors, salt = _factors(-(-bands * band_rows // 2)), mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            counts, nodes, values = [], [], []
            for content in batch.column(3).to_pylist():
                s = shingle_set(content or b"", words)
                counts.append(len(s))
                nodes.append(node_name(s))
                if len(s) == 0:
                    values.append([])
                    continue
                h, signature = salt.copy(), min_max_signature(s, factors)[: bands * band_rows]
                with np.errstate(over="ignore"):
                    for column in signature.reshape(bands, band_rows).T:
                        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + column.astype(np.uint64))
                values.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(values, pa.list_(pa.int64()))], ["_block", "_at", "doc_id", "n_shingles", "node", "bands"])

    return docs.mapInArrow(tidy(run), "_block long, _at long, doc_id long, n_shingles long, node binary, bands array<long>")


def node_name(shingles) -> bytes | None:
    """128-bit digest of a shingle set; none of an empty one."""
    import hashlib

    return hashlib.sha256(shingles.tobytes()).digest()[:16] if len(shingles) else None


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles (bytes of sorted numbers) of the documents at the places of `nodes` (_block, _at, node)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(c or b"", words).tobytes() for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return with_marks(docs.select("_block", "_at", "content"), nodes, run, "node binary, shingles binary")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, node, size, distance, linked) of pairs (hub, node) from whole shingle sets: bytes of the node's set, the Jaccard
    distance, and whether 100 * intersection >= percent * union, in integers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size, distance, linked = [], [], []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                size.append(len(left))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                union = len(x) + len(y) - both
                distance.append(1 - both / union)
                linked.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], ["hub", "node", "size", "distance", "linked"])

    own, hubs = sets.select("node", F.col("shingles").alias("x")), sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y"))
    both = pairs.join(own.hint("merge"), "node").join(hubs.hint("merge"), "hub").select("hub", "node", "x", "y")
    return both.mapInArrow(tidy(run), "hub binary, node binary, size long, distance double, linked boolean")


def linked_matrix(left: list, right: list, percent: int):
    """Matrix of left x right: whether two sets (sorted distinct numbers, none empty) are linked. Intersections of all pairs
    are products of incidence matrices, in strips of shingles that both sides have."""
    import numpy as np

    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    entries = []
    for numbers, size in zip(flat, sizes):
        at = np.minimum(np.searchsorted(common, numbers), max(0, len(common) - 1))
        hit = np.flatnonzero(common[at] == numbers) if len(common) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(size)), size)[hit]
        order = np.argsort(at[hit], kind="stable")
        entries.append((rows[order], at[hit][order]))
    both = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(common), STRIP):
        strips = []
        for (rows, at), size in zip(entries, sizes):
            span = slice(*np.searchsorted(at, [low, low + STRIP]))
            strip = np.zeros((len(size), min(STRIP, len(common) - low)), np.float32)
            strip[rows[span], at[span] - low] = 1
            strips.append(strip)
        both += (strips[0] @ strips[1].T).astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def joined_components(seen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that links inside hub groups join, as a spanning forest of every pair of blocks.

    `seen`: hub, node, size, distance, component, outside (not in the hub's component). Members are put in bins by distance:
    linked ones are in the same or neighbouring bins. A bin has as many blocks as its bytes and its members need, and a
    member's block follows from a hash, so no group is sorted or numbered in one task.
    """
    width = 1 - percent / 100 + 1e-9
    binned = seen.withColumn("bin", F.floor(F.col("distance") / width).cast("int"))
    blocks = lambda who: F.ceil(F.greatest(F.sum(who.cast("long")) / BLOCK, F.sum(F.when(who, F.col("size")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    bins = binned.groupBy("hub", "bin").agg(blocks(F.lit(True)).alias("mb"), blocks(F.col("outside")).alias("ub"))
    plan = bins.groupBy("hub").agg(F.collect_list(F.struct("bin", "mb", "ub")).alias("bins"), F.sum("ub").alias("open")).where("open > 0").drop("open")
    plan = write_table(plan, "plan")  # one row a hub, of known size: broadcast if small, else a skewed hub's members are split
    rows = binned.join(plan, "hub").join(sets.hint("merge"), "node")
    own = "try_element_at(filter(bins, x -> x.bin = bin), 1)"
    all_ = f"pmod(xxhash64(node), {own}.mb)"
    odd = f"pmod(xxhash64(node, 1), {own}.ub)"
    as_member = f"flatten(transform(filter(bins, x -> abs(x.bin - bin) <= 1 and x.ub > 0), x -> transform(sequence(0, x.ub - 1), k -> named_struct('i', x.bin, 'k', k, 'j', bin, 'l', cast({all_} as int), 'side', 1))))"
    as_outside = f"flatten(transform(filter(bins, x -> abs(x.bin - bin) <= 1), x -> transform(sequence(0, x.mb - 1), l -> named_struct('i', bin, 'k', cast({odd} as int), 'j', x.bin, 'l', l, 'side', 0))))"
    rows = rows.withColumn("to", F.explode(F.expr(f"case when outside then concat({as_outside}, {as_member}) else {as_member} end")))
    rows = rows.select("hub", "to.i", "to.k", "to.j", "to.l", "to.side", "node", "component", "shingles")
    keys = ["hub", "i", "k", "j", "l"]
    n = max(1, int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys, "side", "node")

    def forest(group):
        import numpy as np

        sides = [[r for r in group if r[5] == s] for s in (0, 1)]
        if not sides[0] or not sides[1]:
            return
        names, codes = np.unique([r[7] for side in sides for r in side], return_inverse=True)
        left, right = codes[: len(sides[0])], codes[len(sides[0]) :]
        linked = linked_matrix(*([np.frombuffer(r[8], np.uint64) for r in side] for side in sides), percent)
        up = list(range(len(names)))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, row in zip(left.tolist(), linked):
            for y in np.unique(right[row]).tolist():
                a, b = root(x), root(y)
                if a != b:
                    up[b] = a
                    yield bytes(names[x]), bytes(names[y])

    def run(batches):
        import pyarrow as pa

        def result(pairs):
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        group, out = [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:5] != r[:5]:
                    out += forest(group)
                    group = []
                group.append(r)
        out += forest(group) if group else []
        yield result(out)

    return dealt.mapInArrow(tidy(run), "a binary, b binary")


def grouped(docs: DataFrame, words: int, percent: int, bands: int, band_rows: int) -> DataFrame:
    """_block, _at, doc_id, n_shingles, node, component (a node; null without words) of (_block, _at, doc_id, content)."""
    signed = write_table(signatures(docs, words, bands, band_rows), "signed")
    placed = signed.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    name = F.xxhash64("node")
    shared = placed.groupBy("bucket").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("bucket")
    shared = write_table(shared, "buckets")
    members = write_table(placed.join(shared.hint("merge"), "bucket").distinct(), "members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    degrees = members.join(sizes.hint("merge"), "bucket").groupBy("node").agg(F.sum("n").alias("degree"))
    degrees = write_table(degrees, "degrees")
    ranked = members.join(degrees.hint("merge"), "node")
    hubs = write_table(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")), "hubs")
    around = write_table(members.join(hubs.hint("merge"), "bucket").where("node <> hub").select("hub", "node").distinct(), "around")

    stands = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("_block", "_at")).alias("at")).join(degrees.select("node").hint("merge"), "node")
    sets = write_table(shingle_sets(docs, stands.select("at._block", "at._at", "node"), words), "sets")
    first = write_table(measured(around, sets, percent), "measured")
    labels = components(first.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    label, hub_label = labels.select("node", "component"), labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    seen = first.join(label.hint("merge"), "node", "left").join(hub_label.hint("merge"), "hub", "left").withColumn("component", F.coalesce("component", "node"))
    seen = write_table(seen.select("hub", "node", "size", "distance", "component", (F.col("component") != F.coalesce("hub_component", "hub")).alias("outside")), "seen")
    fresh = write_table(joined_components(seen, sets, percent).distinct(), "joined")
    more = components(fresh)
    final = label.unionByName(more.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    final = final.join(more.select(F.col("node").alias("component"), F.col("component").alias("joined")).hint("merge"), "component", "left")
    final = final.select("node", F.coalesce("joined", "component").alias("component"))
    out = signed.drop("bands").join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = write_table(out, "near-rows")
    discard(signed, shared, members, degrees, hubs, around, sets, first, seen, fresh)
    return out


def _found(docs: DataFrame, text: str, id_col: str, words: int, percent: int, bands: int, band_rows: int) -> tuple[DataFrame, DataFrame]:
    """(located documents, rows with component_id and kept)."""
    placed = located(docs)
    base = placed.select("_block", "_at", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.encode(F.col(f"row.`{text}`"), "UTF-8").alias("content"))
    rows = grouped(base, words, percent, bands, band_rows)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_block", "_at"))
    groups = rows.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1").select("component", "best")
    out = rows.join(write_table(groups, "near-groups").hint("merge"), "component", "left")
    alone = F.col("best").isNull()
    first = (F.col("best._block") == F.col("_block")) & (F.col("best._at") == F.col("_at"))
    return placed, out.select("_block", "_at", "doc_id", "n_shingles", F.hex("node").alias("set_digest"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | first).alias("kept"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_digest, component_id, kept.

    component_id is the smallest id reachable over links of at least `percent` per cent similarity, null ids left out (null
    if all are); `kept` marks one row of each group: of the smallest id, one. Null, empty and word-free texts are linked with
    nothing. Rows with equal shingle sets are linked by definition, also repeated rows. Other columns do not matter, and an empty
    table gives an empty result. A pair at the threshold is missed by the bands with a probability of (1 - s^band_rows)^bands
    for min-wise independent hashes: 9e-9 at 0.85 and 2e-5 at 0.8 with the defaults.
    """
    return _found(docs, text, id_col, words, percent, bands, band_rows)[1].drop("_block", "_at")


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, one of each group, with all their columns, whatever these are called. Texts stay where they are.

    Rows with null, empty or word-free texts all stay; of repeated rows one stays; an empty table gives an empty result.
    """
    placed, found = _found(docs, text, id_col, words, percent, BANDS, BAND_ROWS)
    return with_marks(placed, found.where("kept").select("_block", "_at")).select("row.*")
