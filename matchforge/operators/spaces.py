"""Comparison of vector spaces: how far two spaces of the same rows agree on neighbours and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.sources.scratch import blocks, write_shared

ROW_BLOCK = 8192
QUERY_BLOCK = 1024
#: Rows that give every query its first k-th nearest distances. They decide what is skipped early, never what is found.
SAMPLE_ROWS = 2048


def _regular(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose vectors in all columns are finite and of the most frequent lengths (of ties, the smallest)."""
    fine = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    for c in columns:
        df = df.where(fine(c))
    lengths = [F.size(c) for c in columns]
    best = df.groupBy(*[n.alias(f"_n{i}") for i, n in enumerate(lengths)]).count().orderBy(F.desc("count"), *[f"_n{i}" for i in range(len(lengths))]).limit(1)
    same = F.lit(True)
    for i, n in enumerate(lengths):
        same = same & (n == F.col(f"_n{i}"))
    return df.join(F.broadcast(best), same, "left_semi")  # one row


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _distances(rows, query):
    import numpy as np

    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def neighbour_agreement(vectors: DataFrame, key: str, one: str, two: str, k: int = 10, query_every: int = 20) -> DataFrame:
    """One row: queries, pairs, recall (mean share of the k nearest that both spaces have in common), distance_correlation
    (Pearson, of Euclidean distances over all pairs of a query and another row).

    Queries are rows whose key is divisible by `query_every`; ties go to the smaller key. Vectors that are null, hold null, NaN or infinite
    entries, or are not as long as most, are left out, as are null keys. Rows stay where they are: blocks of queries, read from the shared
    folder, go past them, and a task sends on what can be among a query's k nearest, and six sums. No pair becomes a row.
    """
    rows = _regular(vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(one).cast("array<double>").alias("x"), F.col(two).cast("array<double>").alias("y")), ["x", "y"])
    sample_at = write_shared(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS), "sample")

    def first(batches):
        import numpy as np
        import pyarrow as pa

        known = [(b.column(0).to_numpy(), _matrix(b.column(1)), _matrix(b.column(2))) for b in blocks(sample_at, SAMPLE_ROWS)]
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = []
            for space in (1, 2):
                for i, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(space))):
                    d = np.sort(np.concatenate([_distances(s[space], q)[s[0] != i] for s in known]))
                    bounds.append(float(d[k - 1]) if len(d) >= k else float("inf"))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds[:n]), pa.array(bounds[n:])], ["id", "x", "y", "bx", "by"])

    asked = rows.where(F.col("id") % query_every == 0)
    queries_at = write_shared(asked.mapInArrow(first, "id long, x array<double>, y array<double>, bx double, by double"), "queries")

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        names = ["query", "space", "id", "distance", "sums"]
        held, count = [], 0

        def past(table):
            ids, spaces = table.column(0).to_numpy(), [_matrix(table.column(c).combine_chunks()) for c in (1, 2)]
            total = np.zeros(6)
            for block in blocks(queries_at, QUERY_BLOCK):
                out = []
                for i, (q, bx, by) in enumerate(zip(*(block.column(c).to_pylist() for c in (0, 3, 4)))):
                    other, d = ids != q, []
                    for s, bound in enumerate((bx, by)):
                        dist = _distances(spaces[s], np.asarray(block.column(1 + s)[i].values))
                        d.append(dist[other])
                        left = np.flatnonzero(other & (dist <= bound))
                        best = left[np.lexsort((ids[left], dist[left]))[:k]]
                        out += [(q, s, int(ids[j]), float(dist[j]), None) for j in best]
                    u, v = d
                    total += [len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v]
                if out:
                    yield out
            yield [(None, -1, None, None, total.tolist())]

        def made(table):
            for out in past(table):
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROW_BLOCK:
                yield from made(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from made(pa.Table.from_batches(held))

    met = rows.mapInArrow(meet, "query long, space int, id long, distance double, sums array<double>")
    met = rows.sparkSession.read.parquet(write_shared(met, "met"))
    sums = met.where("space < 0").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(6)])
    c = [F.col(f"s{i}") for i in range(6)]
    correlation = F.try_divide(c[0] * c[5] - c[1] * c[2], F.sqrt((c[0] * c[3] - c[1] * c[1]) * (c[0] * c[4] - c[2] * c[2])))
    place = F.row_number().over(Window.partitionBy("query", "space").orderBy("distance", "id"))
    best = met.where("space >= 0").withColumn("place", place).where(F.col("place") <= k)
    both = best.groupBy("query", "id").agg(F.count_distinct("space").alias("n"), F.max((F.col("space") == 0).cast("int")).alias("one"))
    recall = both.groupBy("query").agg((F.sum((F.col("n") == 2).cast("int")) / F.sum("one")).alias("r")).agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))
    return recall.crossJoin(sums.select(c[0].cast("long").alias("pairs"), correlation.alias("distance_correlation")))
