"""Bounded-space online packing of token ids into windows of a fixed length.

Each task keeps a fixed number of open windows. A piece goes to the open window with the least room that holds it;
when none holds it, the fullest window is emitted and a new one opened. Documents longer than a window are first cut
into whole windows and a rest. What is left open when a task ends is packed again, window by window, by tasks that
each take the leftovers of many tasks, so the merge neither meets in one task nor grows with the corpus.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import small_batches, tidy, write_table
from matchforge.llm.tokens import END_ID, default_tokenizer, encoder

WINDOW = 4096
OPEN_WINDOWS = 64
FAN_IN = 32
LEVELS = 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, full boolean"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class OpenWindows:
    """The open windows of one task. Items are lists of pieces; `place` returns the windows that are finished."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.open = window, most, []  # [room, pieces] each

    def place(self, length: int, pieces: list) -> list:
        best = None
        for w in self.open:
            if length <= w[0] and (best is None or w[0] < best[0]):
                best = w
        emitted = []
        if best is None:
            if len(self.open) >= self.most:
                fullest = min(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                emitted.append(fullest[1])
            best = [self.window, []]
            self.open.append(best)
        best[0] -= length
        best[1].extend(pieces)
        if best[0] == 0:
            self.open.remove(best)
            emitted.append(best[1])
        return emitted


def _rows(windows: list, task: int, counter: int, full: bool):
    """(doc_id, start, length, crc, doc_tokens) lists of windows as rows with sequence and offset."""
    for pieces in windows:
        at = 0
        for p in pieces:
            yield (*p, (task << 32) + counter, at, task, full)
            at += p[2]
        counter += 1


def _batches(rows, schema, size: int = 20_000):
    import pyarrow as pa

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _schema():
    import pyarrow as pa

    return pa.schema([(n, pa.bool_() if n == "full" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "full")])


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents: one row per piece (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and an end id; null and empty texts have the end id only. Every id is in exactly one piece;
    pieces of a sequence follow each other without gaps. Repeated rows and null ids are documents like others. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def first(batches):
        import numpy as np
        from pyspark import TaskContext

        codes, task, counter = encoder(path), TaskContext.get().partitionId(), 0
        end, held = np.array([END_ID], "<u2").tobytes(), OpenWindows(window, open_windows)

        def rows():
            nonlocal counter
            for batch in batches:
                for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(codes.encode(content or b"") + end, "<u2").astype("<u4")
                    n = len(ids)
                    for start in range(0, n, window):
                        part = ids[start : start + window]
                        for done in held.place(len(part), [(doc_id, start, len(part), zlib.crc32(part.tobytes()), n)]):
                            yield from _rows([done], task, counter, True)
                            counter += 1
            yield from _rows([w[1] for w in held.open], task, counter, False)

        yield from _batches(rows(), _schema())

    def merge(level: int, last: bool):
        def run(batches):
            from pyspark import TaskContext

            task, counter = (level << 24) + TaskContext.get().partitionId(), 0
            held = OpenWindows(window, open_windows)

            def leftovers():
                key, pieces = None, []
                for batch in batches:
                    for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                        if row[5] != key and pieces:
                            yield pieces
                            pieces = []
                        key = row[5]
                        pieces.append(row[:5])
                if pieces:
                    yield pieces

            def rows():
                nonlocal counter
                for pieces in leftovers():
                    for done in held.place(sum(p[2] for p in pieces), pieces):
                        yield from _rows([done], task, counter, True)
                        counter += 1
                yield from _rows([w[1] for w in held.open], task, counter, last)

            yield from _batches(rows(), _schema())

        return run

    content = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("content"))
    packed = write_table(content.mapInArrow(tidy(first), PIECE), "packed-0")
    out, tasks = packed.where("full"), packed.agg(F.max("task")).first()[0]
    tasks = 0 if tasks is None else tasks + 1
    left = packed.where("not full")
    for level in range(1, LEVELS + 1):
        groups = max(1, -(-tasks // FAN_IN))
        last = level == LEVELS or groups == 1
        order = left.withColumn("task", F.floor(F.col("task") % (1 << 24) / FAN_IN)) if level > 1 else left.withColumn("task", F.floor(F.col("task") / FAN_IN))
        dealt = order.repartitionById(groups, F.col("task").cast("int")).sortWithinPartitions("sequence_id", "offset")
        merged = write_table(dealt.mapInArrow(merge(level, last), PIECE), f"packed-{level}")
        out, left, tasks = out.unionByName(merged.where("full")), merged.where("not full"), groups
        if last:
            break
    return out.select(*COLUMNS)


def sequence_fill(pieces: DataFrame) -> DataFrame:
    """Length of each sequence, by sequence_id."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("pieces"))
