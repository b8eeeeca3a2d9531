"""Token ids in training order: fixed-length sequences at keyed pseudo-random slots, in shards of a fixed stride.

Texts become ids, laid end to end in an order that follows from their contents, and cut into sequences. A keyed Feistel network with cycle-walking
permutes 0..N-1, so every sequence has a global slot that can be computed, and undone, without a table. Slots are dealt
by range: shard k holds the slots from k * shard_sequences on, in order, each record at a place that follows from its slot.
So a reader starts anywhere, and goes on after a stop, by one seek.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import filesystem, located, running_sums, scratch_path, small_batches, tidy, with_marks, write_file, write_table
from matchforge.llm.tokens import END_ID, default_tokenizer, encoder

SEQUENCE = 2048
SHARD_SEQUENCES = 8192
ROUNDS = 6
LENGTH_BYTES = 4


def feistel(x, n: int, key: int, inverse: bool = False):
    """Permutation of 0..n-1 (numpy array of int64): a balanced Feistel network on the next even power of two, walked
    along its cycles until the value is below n."""
    import numpy as np

    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xBF58476D1CE4E5B9) & (2**64 - 1)) for r in range(ROUNDS)]

    def mixed(v, k):
        with np.errstate(over="ignore"):
            v = (v ^ k) * np.uint64(0xFF51AFD7ED558CCD)
            v = (v ^ (v >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return v ^ (v >> np.uint64(29))

    out = np.asarray(x, np.int64).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in rounds:
            if inverse:
                left, right = right ^ (mixed(left, keys[r]) & mask), left
            else:
                left, right = right, left ^ (mixed(right, keys[r]) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def document_tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, digest, tokens, ids: little-endian 16-bit ids with the end id) of every text; null texts are empty. A narrow step."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        import xxhash

        codes, end = encoder(path), struct.pack("<H", END_ID)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            ids = [codes.encode(t) + end for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "digest", "tokens", "ids"])

    content = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("content"))
    return content.mapInArrow(tidy(run), "doc_id long, digest binary, tokens long, ids binary")


def sequence_pieces(tokens: DataFrame, offsets: DataFrame, total: int, key: int, sequence: int) -> DataFrame:
    """(slot, start, ids: compressed) of the pieces into which the borders of sequences cut documents.

    `tokens` is a located table of document_tokens, `offsets` tells for each of its places how many ids come before it.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            numbers, starts, parts = [], [], []
            for row, first in zip(batch.column(0).field("ids").to_pylist(), batch.column(3).to_pylist()):
                at, done, n = first, 0, len(row) // 2
                while done < n:
                    take = min(n - done, sequence - at % sequence)
                    numbers.append(at // sequence)
                    starts.append(at % sequence)
                    parts.append(coder.compress(row[2 * done : 2 * (done + take)]))
                    at, done = at + take, done + take
            slots = feistel(np.array(numbers, np.int64), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["slot", "start", "ids"])

    return with_marks(tokens, offsets, run, "slot long, start long, ids binary")


@dataclass
class Shards:
    """manifest: shard, path, first_slot, sequences. total: number of sequences. key, sequence, shard_sequences as written."""

    manifest: DataFrame
    total: int
    key: int
    sequence: int
    shard_sequences: int

    @property
    def stride(self) -> int:
        return LENGTH_BYTES + 2 * self.sequence

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset in it) of a slot."""
        return slot // self.shard_sequences, slot % self.shard_sequences * self.stride


def write_shards(docs: DataFrame, key: int = 20240501, directory: str | None = None, text: str = "text", id_col: str = "doc_id", sequence: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES, tokenizer: str | None = None) -> Shards:
    """Write all sequences of all texts to shards in the order of their slots. An empty table writes none.

    The texts' ids, each text's followed by the end id, are laid end to end in the order of document id (null first) and a digest
    of the text, and cut into sequences; only the last may be shorter. So slots follow from the contents and the key, however
    the input is dealt and however often a task runs; rows of equal id and text are alike. Ids are computed once and kept in
    the shared folder, and only narrow rows are sorted: places come from sums over ranges.
    """
    spark = docs.sparkSession
    directory = directory or scratch_path(spark, "shards")
    made = document_tokens(docs, text, id_col, tokenizer)
    path = scratch_path(spark, "tokens")
    made.write.option("compression", "zstd").parquet(path)
    tokens = located(spark.read.schema(made.schema).parquet(path))
    places = tokens.select("_block", "_at", F.col("row.doc_id").alias("doc_id"), F.col("row.digest").alias("digest"), F.col("row.tokens").alias("tokens"))
    offsets = running_sums(places, ["doc_id", "digest", "_block", "_at"], {"first": F.col("tokens")})
    total_ids = places.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = -(-total_ids // sequence)
    shards = max(1, -(-total // shard_sequences))
    pieces = sequence_pieces(tokens, offsets.select("_block", "_at", F.col("first").cast("long").alias("first")), total, key, sequence)
    dealt = pieces.repartitionById(shards, F.floor(F.col("slot") / shard_sequences).cast("int")).sortWithinPartitions("slot", "start")

    def run(batches):
        import pyarrow as pa
        import zstandard

        decoder, first, n = zstandard.ZstdDecompressor(), None, 0

        def record(parts):
            ids = b"".join(parts)
            return (len(ids) // 2).to_bytes(LENGTH_BYTES, "little") + ids.ljust(2 * sequence, b"\0")

        def records():
            nonlocal first, n
            held, parts = None, []
            for batch in batches:
                for slot, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if slot != held and parts:
                        yield record(parts)
                        parts = []
                    if slot != held:
                        first, held, n = slot if first is None else first, slot, n + 1
                    parts.append(decoder.decompress(ids, max_output_size=2 * sequence))
            if parts:
                yield record(parts)

        source = records()
        head = next(source, None)
        if head is None:
            return
        shard = first // shard_sequences
        path = f"{directory}/shard-{shard:08d}.bin"

        def chained():
            yield head
            yield from source

        write_file(path, chained())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([first], pa.int64()), pa.array([n], pa.int64())], ["shard", "path", "first_slot", "sequences"])

    manifest = write_table(dealt.mapInArrow(run, "shard long, path string, first_slot long, sequences long"), "manifest")
    return Shards(manifest, total, key, sequence, shard_sequences)


def read_shards(shards: Shards, start_slot: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, sequence, shard, offset, tokens, ids, ids_crc32) from `start_slot` on, read sequentially shard by shard; null ids if
    they are not wanted, so that only their digests leave the task.

    `sequence` is the number before the permutation. A shard whose size does not fit its stride fails the job.
    """
    stride, per, total, key = shards.stride, shards.shard_sequences, shards.total, shards.key
    n = max(1, int(shards.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, path, sequences in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inside = filesystem(path)
                if fs.get_file_info(inside).size != sequences * stride:
                    raise ValueError(f"shard {shard} does not hold {sequences} records")
                skip = max(0, start_slot - shard * per)
                with fs.open_input_file(inside) as f:
                    f.seek(skip * stride)
                    for at in range(skip, sequences, 1024):
                        count = min(1024, sequences - at)
                        data = f.read(count * stride)
                        slots = np.arange(at, at + count) + shard * per
                        rows = np.frombuffer(data, np.uint8).reshape(count, stride)
                        lengths = rows[:, :LENGTH_BYTES].copy().view("<u4").ravel().astype(np.int64)
                        wide = rows[:, LENGTH_BYTES:].copy().view("<u2").astype("<u4")
                        crcs = [zlib.crc32(r[:m]) for r, m in zip(wide, lengths)]
                        ids = [data[i * stride + LENGTH_BYTES : i * stride + LENGTH_BYTES + 2 * m] if with_ids else None for i, m in enumerate(lengths)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slots, pa.int64()), pa.array(feistel(slots, total, key, inverse=True), pa.int64()), pa.array([shard] * count, pa.int64()), pa.array((np.arange(at, at + count)) * stride, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64())],
                            ["slot", "sequence", "shard", "offset", "tokens", "ids", "ids_crc32"],
                        )

    wanted = shards.manifest.where((F.col("shard") + 1) * per > start_slot).select("shard", "path", "sequences")
    return wanted.repartition(n, "shard").mapInArrow(run, "slot long, sequence long, shard long, offset long, tokens long, ids binary, ids_crc32 long")
