"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs: tables (h1, h2, docs) bucketed and sorted by the 128-bit hash of a line's key, one row per hash.
A batch of documents counts its keys, merge-anti-joins the runs' keys that are settled (a run already holds them in enough
documents) and adds the rest as its own run to level 0. Every FANOUT batches level 0 is merged with the run of level 1, and
a run that outgrows its level with the next one, so a key is rewritten a few times per level, however many batches come. A key's count is
the sum over the runs, of which there are a few at any time.

Buckets of runs and of batches are the same, so merges and anti-joins move no run through a shuffle. Common lines are counted per
block of documents before they are shuffled. The list of runs is a small file in the shared folder that is written
anew under the next number: a batch that dies leaves the list before it valid.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchforge.llm._common import SPACES, filesystem, located, read_block, scratch_path, small_batches, tidy, write_blocks, write_file, write_table

#: Runs of level 0 that are merged at a time, and how much larger each level is than the one above.
FANOUT = 4
#: Keys of level 1; a run beyond it goes down a level.
LEVEL_KEYS = 1 << 28
#: Batches that a table is read in, by its files.
BATCHES = 6
#: Distinct keys of a block that are counted in a task before they are handed on.
HELD_KEYS = 1 << 17
_BLANK = SPACES.encode()


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(_BLANK).lower()


def _hashed(least_points: int):
    """Hash of a line, or None if its key has fewer code points."""
    import xxhash

    def of(line: bytes):
        key = line_key(line)
        if len(key) < 4 * least_points and len(key.decode("utf-8", "replace")) < least_points:
            return None
        return xxhash.xxh3_128_digest(key)

    return of


def _lines(text: bytes | None) -> list:
    return (text or b"").split(b"\n")


def line_counts(placed: DataFrame, text: str, least_points: int) -> DataFrame:
    """_block, h1, h2, docs: documents of a block that hold a line's key; a block with many keys gives a key more than once."""
    small_batches(placed.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = _hashed(least_points)

        def done(block, held):
            keys = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            cols = [pa.array(np.full(len(keys), block)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(np.fromiter(held.values(), np.int64, len(keys)))]
            return pa.RecordBatch.from_arrays(cols, ["_block", "h1", "h2", "docs"])

        at, held = None, {}
        for batch in batches:
            for block, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and (block != at or len(held) >= HELD_KEYS):
                    yield done(at, held)
                    held = {}
                at = block
                for h in {of(x) for x in _lines(t.as_py())}:
                    if h is not None:
                        held[h] = held.get(h, 0) + 1
        if held:
            yield done(at, held)

    return placed.select("_block", F.col(f"row.`{text}`").cast("binary").alias("text")).mapInArrow(tidy(run), "_block long, h1 long, h2 long, docs long")


class LineIndex:
    """Counts of line keys over all batches that were added; `path` is a folder all machines share."""

    def __init__(self, spark: SparkSession, path: str, settled: int, buckets: int | None = None, fanout: int = FANOUT, level_keys: int = LEVEL_KEYS):
        self.spark, self.path, self.settled, self.fanout, self.level_keys = spark, path.rstrip("/"), settled, fanout, level_keys
        self._names: list = []
        known = self._state()
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _state(self) -> dict | None:
        """The newest list of runs."""
        import pyarrow.fs as pafs

        fs, path = filesystem(self.path)
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if re.fullmatch(r"runs-\d{9}", f.base_name)]
        if not names:
            return None
        with fs.open_input_stream(f"{path}/{max(names)}") as f:
            return json.loads(f.read())

    def _levels(self) -> list:
        """Runs by level: {name, keys}."""
        return (self._state() or {"levels": [[]]})["levels"]

    def _publish(self, levels: list) -> None:
        known = self._state()
        state = {"number": known["number"] + 1 if known else 0, "buckets": self.buckets, "levels": levels}
        write_file(f"{self.path}/runs-{state['number']:09d}", [json.dumps(state).encode()])

    def _write(self, counts: DataFrame) -> dict:
        """A run of distinct keys, in buckets sorted by hash."""
        name = uuid.uuid4().hex
        table = counts.select("h1", "h2", "docs").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/run={name}")
        table.saveAsTable(f"line_run_{name}")
        keys = self.spark.table(f"line_run_{name}").count()
        self.spark.sql(f"DROP TABLE line_run_{name}")  # the files stay
        return {"name": name, "keys": keys}

    def _read(self, runs: list) -> DataFrame:
        """All rows of the runs as one bucketed table, whose partitions they are."""
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        name = f"line_runs_{uuid.uuid4().hex}"
        buckets = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, docs BIGINT, run STRING) USING parquet PARTITIONED BY (run) {buckets} LOCATION '{self.path}'")
        self._names.append(name)
        self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (run = '{r['name']}')" for r in runs))
        return self.spark.table(name).select("h1", "h2", "docs")

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, docs), keys in any number of rows."""
        batch = counts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
        levels = self._levels()
        runs = [r for level in levels for r in level]
        if runs:
            batch = batch.join(self._read(runs).where(F.col("docs") >= self.settled).hint("merge"), ["h1", "h2"], "left_anti")
        levels[0].append(self._write(batch))
        self._publish(levels)
        if len(levels[0]) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge level 0 into level 1, and every run that outgrew its level into the next; merged runs are removed once the new list stands."""
        levels, old, at = self._levels(), [], 0
        while levels[at] and (at == 0 or sum(r["keys"] for r in levels[at]) > self.level_keys * self.fanout ** (at - 1)):
            if len(levels) == at + 1:
                levels.append([])
            merged = levels[at] + levels[at + 1]
            run = self._write(self._totals(merged))
            old += merged
            levels[at], levels[at + 1], at = [], [run], at + 1
        self._publish(levels)
        self.close()
        fs, path = filesystem(self.path)
        for r in old:
            fs.delete_dir(f"{path}/run={r['name']}")

    def _totals(self, runs: list) -> DataFrame:
        return self._read(runs).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def frequent(self, documents: int) -> DataFrame:
        """h1, h2 of keys in at least `documents` documents, which is not above `settled`."""
        if documents > self.settled:
            raise ValueError("keys are not counted beyond the number that settles them")
        return self._totals([r for level in self._levels() for r in level]).where(F.col("docs") >= documents).select("h1", "h2")

    def close(self) -> None:
        """Forget the names that tables had in this session; the files stay, and another index on this path goes on with them."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = []


def batches_of(placed: DataFrame, batches: int) -> list:
    """Lists of the files of located documents; each file is in one of them."""
    files = sorted(placed.inputFiles())
    return [files[k::batches] for k in range(min(batches, len(files)))]


def without_frequent_lines(docs: DataFrame, documents: int = 10, least_points: int = 1, text: str = "text", id_col: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: every document without the lines whose key is in at least `documents` documents.

    Lines end at newlines; a key is the line without ASCII white space at both ends, in lower case (A-Z). Keys of fewer than
    `least_points` code points always stay. A null or empty text is one empty line. Repeated rows are documents of their own. Other
    columns do not matter; an empty table gives an empty result. Texts are never shuffled: each block of documents loads the
    frequent keys among its own.
    """
    spark = docs.sparkSession
    placed = located(docs)
    index = LineIndex(spark, scratch_path(spark, "line-index"), settled=documents)
    counted = []
    only = T.StructType([placed.schema["row"].dataType[text]])
    for files in batches_of(placed, batches):
        part = located(spark.read.schema(only).parquet(*files))
        counts = write_table(line_counts(part, text, least_points), "line-counts")
        index.add(counts)
        counted.append(counts)
    if not counted:
        counted = [spark.createDataFrame([], "_block long, h1 long, h2 long, docs long")]
    frequent = write_table(index.frequent(documents), "frequent-lines")
    index.close()
    seen = counted[0]
    for c in counted[1:]:
        seen = seen.unionByName(c)
    folder = scratch_path(spark, "line-marks")
    write_blocks(seen.join(frequent, ["h1", "h2"], "left_semi").select("_block", "h1", "h2"), folder)

    def run(blocks):
        import numpy as np
        import pyarrow as pa

        of = _hashed(least_points)
        at, marks = None, frozenset()
        for batch in blocks:
            ids, sizes, dropped, kept = batch.column(1), [], [], []
            for block, t in zip(batch.column(0).to_pylist(), batch.column(2)):
                if block != at:
                    at, held = block, read_block(folder, block, ["h1", "h2"])
                    both = None if held is None else np.stack([held.column(c).to_numpy() for c in ("h1", "h2")], axis=1).astype("<i8")
                    marks = frozenset() if both is None else frozenset(r.tobytes() for r in both)
                lines = _lines(t.as_py())
                stay = [x for x in lines if of(x) not in marks] if marks else lines
                sizes.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    rows = placed.select("_block", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_lines long, n_dropped long, kept binary").withColumn("kept", F.col("kept").cast("string"))
