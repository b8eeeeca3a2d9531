"""Shared helpers: shared scratch tables, places of rows in files and marks on them, word counting, row numbers, binary files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: ASCII white space, the separators of every word definition here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Only for sessions on one machine that name no shared folder, such as local tests.
LOCAL_SHARED = "file:///tmp/checkpoints/matchforge"
#: Rows of a file that share their marks: what a task holds of them at a time.
BLOCK_ROWS = 8192


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir or the context's checkpoint folder; a local one only if the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = LOCAL_SHARED
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder; two calls never meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    The table outlives lost executors, is computed once, and has sizes the optimiser knows, so joins with it
    can be broadcast or split when skewed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of write_table that nothing reads any more."""
    for table in tables:
        if getattr(table, "_scratch", None):
            fs, path = filesystem(table._scratch)
            fs.delete_dir(path)


def located(docs: DataFrame) -> DataFrame:
    """(row: all columns as one struct, _block, _at): `_at` is the row's number in its file, `_block` names its file and a
    stretch of BLOCK_ROWS rows there. The same each time, however the scan is split. What is not a scan of Parquet is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = write_table(docs, "documents")
    at = F.col("_metadata.row_index")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("_metadata.file_path"), F.floor(at / BLOCK_ROWS)).alias("_block"), at.alias("_at"))


def write_blocks(df: DataFrame, folder: str) -> None:
    """One folder of Parquet files for every `_block`."""
    df.repartition("_block").write.partitionBy("_block").parquet(folder)


def read_block(folder: str, block: int, columns: list[str]):
    """Arrow table of a block's rows, or None if it has none."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = filesystem(f"{folder}/_block={block}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    return pq.read_table(path, filesystem=fs, columns=columns, partitioning=None)


def with_marks(rows: DataFrame, marks: DataFrame, then=None, schema: str | None = None) -> DataFrame:
    """Inner join of `rows` and `marks` by `_block` and `_at` (unique in `marks`) in which `rows` stay where they are.

    Marks are dealt by block and written; the task that reads a block of rows loads the marks of that block only. So texts
    are never shuffled and nothing is broadcast, at any size. `then` makes batches of `schema` of the joined batches in the
    same Python worker.
    """
    small_batches(rows.sparkSession)
    folder = scratch_path(rows.sparkSession, "marks")
    write_blocks(marks, folder)
    extra = [f for f in marks.schema.fields if f.name not in ("_block", "_at")]
    names = [f.name for f in extra]
    block_at, row_at = rows.columns.index("_block"), rows.columns.index("_at")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        block, held, keys = None, None, None
        for batch in batches:
            blocks, at = batch.column(block_at).to_numpy(), batch.column(row_at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if blocks[low] != block:
                    block, held = blocks[low], read_block(folder, blocks[low], ["_at", *names])
                    if held is not None:
                        held = held.combine_chunks().sort_by("_at")
                        keys = held.column("_at").to_numpy()
                if held is None or not len(keys):
                    continue
                place = np.minimum(np.searchsorted(keys, at[low:high]), len(keys) - 1)
                hit = keys[place] == at[low:high]
                if hit.any():
                    mine, theirs = batch.slice(low, high - low).filter(pa.array(hit)), held.take(pa.array(place[hit])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*mine.columns, *(theirs.column(n).combine_chunks() for n in names)], [*batch.schema.names, *names])

    if then is not None:
        return rows.mapInArrow(tidy(lambda batches: then(run(batches))), schema)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, *extra]))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python tasks hold: long texts make the default of 10,000 rows too large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def tidy(run):
    """`run` of mapInArrow that gives memory back when its task ends: Python workers serve many tasks, of other steps too."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def word_count(text):
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def running_sums(df: DataFrame, keys: list, values: dict) -> DataFrame:
    """Add, for each name in `values`, the sum of its column over all rows that come before in the order of `keys`.

    No task sees all rows: they are dealt by range and written, each range sums its rows, and only one sum per range is added up in order.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = write_table(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "dealt")
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(parts), F.lit(0)).alias(f"_{k}") for k in values])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = {k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()}
    out = dealt.withColumns(sums).join(totals, "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).drop("_part", *[f"_{k}" for k in values])


def ranked(df: DataFrame, keys: list, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of every row in the order of `keys`, without gathering all rows in one task."""
    return running_sums(df, keys, {name: F.lit(1).cast("long")})


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for tasks that write binary files; `file:`, `hdfs:`, `s3:` and `gs:` work."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write the byte chunks under a temporary name, then rename; a failed attempt leaves no file of the final name."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, total = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            total += len(chunk)
    fs.move(part, path)
    return total
