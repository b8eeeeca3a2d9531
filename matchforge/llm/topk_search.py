"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is summarised by the mean and the deviation norm of its segments, for a coarse and a fine cut. Of two
vectors, the squared distance is at least the sum over segments of length * (difference of means)^2 +
(difference of deviation norms)^2; with both squared norms known this bounds their inner product from above. Blocks of
rows meet blocks of queries: coarse bounds first, fine bounds for what is left, then exact integer products for the
survivors. Bounds get a small allowance for rounding, so no row is lost.

Rows stay where they are: a task holds one block of its rows, and the blocks of queries, read from the shared folder, go
past it. Every query brings along its k-th best score in a bounded sample of rows, below which nothing can be among its
best; so most blocks send nothing on, and neither rows nor queries are copied in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.llm._common import filesystem, small_batches, write_table

QUERY_BLOCK = 2048
ROW_BLOCK = 16_384
#: Rows that give every query its first k-th best score. It decides what is skipped early, never what is found.
SAMPLE_ROWS = 4096
SEGMENTS = (4, 16)


def finite_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """row, vec_id, dims, parts (doubles). Vectors that are null or hold null, NaN or infinite components are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.size(vector).alias("dims"), v.alias("parts"))


def segment_statistics(m, segments: int):
    """(sqrt(length) * mean, deviation norm) of each segment of each row of a matrix, side by side: their products with
    those of another vector sum to an upper bound of the inner product."""
    import numpy as np

    parts = np.array_split(np.arange(m.shape[1]), min(segments, max(1, m.shape[1])))
    means, devs = [], []
    for p in parts:
        x = m[:, p]
        mean = x.mean(axis=1) if len(p) else np.zeros(len(m))
        means.append(mean * np.sqrt(len(p)))
        devs.append(np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means + devs, axis=1)


def exact_products(rows, query, scale: int):
    """Inner products of floor(scale * x) of rows with those of a query, as Python integers, for components of any size."""
    whole = [[_floor(x, scale) for x in r] for r in rows.tolist()]
    own = [_floor(x, scale) for x in query.tolist()]
    return [sum(a * b for a, b in zip(r, own)) for r in whole]


def _floor(x: float, scale: int) -> int:
    n, d = x.as_integer_ratio()
    return n * scale // d


class Side:
    """Vectors of one block as doubles floor(scale * x), their statistics, and which are small enough for exact sums of doubles."""

    def __init__(self, parts, scale: int, segments=SEGMENTS):
        import numpy as np

        self.parts = parts
        with np.errstate(over="ignore"):
            self.ints = np.floor(parts * scale)
        top = np.abs(self.ints).max(axis=1, initial=0)
        self.small = top * top * max(1, parts.shape[1]) < 2.0**53
        self.bounded = top < 1e150
        ints = np.where(self.bounded[:, None], self.ints, 0)
        self.norms = 1 + np.sqrt((ints * ints).sum(axis=1))
        self.stats = [segment_statistics(ints, s) for s in segments]


def block_top_k(queries: Side, query_rows, rows: Side, row_ids, vec_ids, least, k: int, scale: int):
    """(query position, row position, score) of the k best rows of this block for each query, of those with a score of at
    least `least` (one number per query); ties go to the smaller id. A query never meets its own row. Scores are Python integers."""
    import numpy as np

    out = []
    if not len(row_ids):
        return out
    coarse = queries.stats[0] @ rows.stats[0].T
    for i in range(len(query_rows)):
        other = row_ids != query_rows[i]
        slack = 1e-9 * queries.norms[i] * rows.norms
        loose = ~rows.bounded if queries.bounded[i] else np.ones(len(other), bool)
        left = np.flatnonzero(other & (loose | (coarse[i] + slack >= least[i])))
        for a, b in zip(queries.stats[1:], rows.stats[1:]):
            left = left[loose[left] | (b[left] @ a[i] + slack[left] >= least[i])]
        if not len(left):
            continue
        if queries.small[i] and rows.small[left].all():
            s = (rows.ints[left] @ queries.ints[i]).astype(np.int64)
            best = left[np.lexsort((row_ids[left], vec_ids[left], -s))[:k]]
            scores = (rows.ints[best] @ queries.ints[i]).astype(np.int64).tolist()
        else:
            if not loose[left].any():
                about = rows.ints[left] @ queries.ints[i]
                at_least = min(2.0**62, np.sort(about - slack[left])[::-1][min(k, len(left)) - 1])
                left = left[about + slack[left] >= at_least]
            s = [min((1 << 63) - 1, max(-(1 << 63), x)) for x in exact_products(rows.parts[left], queries.parts[i], scale)]
            order = sorted(range(len(left)), key=lambda t: (-s[t], vec_ids[left[t]], row_ids[left[t]]))[:k]
            best, scores = left[order], [s[t] for t in order]
        out += [(i, j, x) for j, x in zip(best.tolist(), scores) if x >= least[i]]
    return out


def _held(batches, rows: int):
    """Arrow tables of at most about `rows` rows each."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _by_dims(table):
    """(dims, row, vec_id with null as the largest number, parts, positions) of the vectors of each dimension."""
    import numpy as np

    dims = table.column("dims").to_numpy()
    ids = table.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        parts = np.array(table.column("parts").take(at).combine_chunks().flatten(), np.float64).reshape(len(at), d)
        yield int(d), table.column("row").to_numpy()[at], ids[at], parts, at


def _files(folder: str, rows: int):
    """Blocks of a Parquet table in the shared folder."""
    import pyarrow.dataset as ds

    fs, path = filesystem(folder)
    return _held(ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=rows), rows)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, query_every: int = 50, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner product of floor(scale * component) for every query row.

    Queries are rows whose id is divisible by `query_every`; candidates are all other rows of the same dimension. Ties go
    to the smaller id, then to the earlier row; rows with a null id are candidates and come last in ties. Fewer
    candidates give fewer rows; an empty table gives none. Products are exact; one that 64 bits
    do not hold counts as the nearest number that they hold, also in ties. Blocks of rows and of queries have a fixed size, so tasks need the same memory at any
    scale; each block sends at most k rows per query on.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = write_table(finite_vectors(vectors, id_col, vector), "vectors")
    sample = write_table(rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS), "sample")
    sample_at = sample._scratch

    def first(batches):
        import numpy as np
        import pyarrow as pa

        known = {d: (r, v, Side(p, scale)) for t in _files(sample_at, SAMPLE_ROWS) for d, r, v, p, _ in _by_dims(t)}
        for table in _held(batches, query_block):
            least = [None] * table.num_rows
            for d, qr, _, parts, at in _by_dims(table):
                if d in known:
                    r, v, side = known[d]
                    best: dict = {}
                    for i, _, x in block_top_k(Side(parts, scale), qr, side, r, v, np.full(len(qr), -np.inf), k, scale):
                        best.setdefault(i, []).append(x)
                    for i, found in best.items():
                        if len(found) >= k and abs(found[-1]) < 1 << 53:
                            least[at[i]] = float(found[-1])
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), pa.array(least, pa.float64())], [*table.column_names, "least"])

    asked = rows.where(F.col("vec_id") % query_every == 0)
    queries = write_table(asked.mapInArrow(first, "row long, vec_id long, dims int, parts array<double>, least double"), "queries")
    queries_at = queries._scratch

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["query_row", "query_id", "row", "vec_id", "score"]
        null = np.iinfo(np.int64).max
        for table in _held(batches, row_block):
            mine = {d: (r, v, Side(p, scale)) for d, r, v, p, _ in _by_dims(table)}
            for block in _files(queries_at, query_block):
                least = block.column("least").fill_null(-np.inf).to_numpy()
                out = []
                for d, qr, qv, parts, at in _by_dims(block):
                    if d in mine:
                        r, v, side = mine[d]
                        for i, j, x in block_top_k(Side(parts, scale), qr, side, r, v, least[at], k, scale):
                            out.append((int(qr[i]), int(qv[i]), int(r[j]), None if v[j] == null else int(v[j]), x))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    found = rows.mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
