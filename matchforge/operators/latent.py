"""Blocks of latent features: principal components with standardised scores, and diagnostics of their columns."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_block(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """((key, scores: array of k standardised scores), explained ratios). Signs of components are arbitrary; null vectors are left out.
    Without vectors there are no scores and no ratios."""
    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    if rows.isEmpty():
        return rows.select(key, F.array().cast("array<double>").alias("scores")), []
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(rows)
    scored = model.transform(rows).select(key, vector_to_array("_s").alias("_s"))
    stats = scored.agg(*[F.avg(F.col("_s")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_samp(F.col("_s")[i]).alias(f"d{i}") for i in range(k)])
    z = [F.when(F.col(f"d{i}") > 1e-12, (F.col("_s")[i] - F.col(f"m{i}")) / F.col(f"d{i}")).otherwise(0.0) for i in range(k)]
    return scored.crossJoin(stats).select(key, F.array(*z).alias("scores")), model.explainedVariance.toArray().tolist()


def finite_rows(df: DataFrame, vector: str) -> DataFrame:
    """`_v` (doubles) of the vectors of the most frequent length (of ties, the smallest) without null, NaN or infinite entries."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(v.alias("_v"))
    best = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(best), F.size("_v") == F.col("d"), "left_semi")  # one row


def gram(df: DataFrame, vector: str) -> DataFrame:
    """i, n, sum, products: for each column i of the vectors, its sum and the sums of its products with all columns.

    Tasks make the whole matrix of their rows by one product and send one row per column; these are added by column in two
    steps, so a task holds a few rows of the matrix, for any number of columns.
    """
    rows = finite_rows(df, vector)
    schema = "i int, n long, sum double, products array<double>"

    def part(batches):
        import numpy as np
        import pyarrow as pa

        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n and len(total):
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total), pa.array(list(products), pa.list_(pa.float64()))], ["i", "n", "sum", "products"])

    def added(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for i, n, s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                p = p.values.to_numpy()
                m, t, q = held.get(i, (0, 0.0, 0.0))
                held[i] = (m + n, t + s, q + p)
        if held:
            rows = [(i, *held[i]) for i in sorted(held)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([float(r[2]) for r in rows]), pa.array([np.asarray(r[3]) for r in rows], pa.list_(pa.float64()))], ["i", "n", "sum", "products"])

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = rows.mapInArrow(part, schema).repartition(n, "i", F.spark_partition_id() % 16).mapInArrow(added, schema)
    return some.repartition(n, "i").mapInArrow(added, schema)


def covariances(df: DataFrame, vector: str) -> DataFrame:
    """i, j, n, covariance (divisor n) of every pair of columns of the vectors, i <= j."""
    g = gram(df, vector)
    long = g.select("i", "n", F.col("sum").alias("si"), F.posexplode("products").alias("j", "p")).where("i <= j")
    mean = g.select(F.col("i").alias("j"), F.col("sum").alias("sj"))
    return long.join(mean, "j").select("i", "j", "n", (F.col("p") / F.col("n") - F.col("si") * F.col("sj") / F.col("n") / F.col("n")).alias("covariance"))


def column_diagnostics(df: DataFrame, vector: str, least: float = 1e-6) -> DataFrame:
    """One row: rows, active_dims (columns whose variance is above `least`), effective_rank (exponential of the entropy of the
    covariance's eigenvalues), mean_abs_correlation (over pairs of active columns). Without vectors there is no row.

    The columns' matrix is made by `gram` and reaches the driver, which finds its eigenvalues; rows never do.
    """
    import numpy as np

    schema = "rows long, active_dims int, effective_rank double, mean_abs_correlation double"
    held = sorted(gram(df, vector).collect())  # as many rows as columns
    if not held:
        return df.sparkSession.createDataFrame([], schema)
    n, mean = held[0].n, np.array([r.sum for r in held]) / held[0].n
    covariance = np.array([r.products for r in held]) / n - np.outer(mean, mean)
    variance = np.diag(covariance)
    active = variance > least
    values = np.maximum(np.linalg.eigvalsh(covariance), 0)
    shares = values[values > 0] / values.sum() if values.sum() > 0 else np.ones(1)
    sub = covariance[np.ix_(active, active)] / np.sqrt(np.outer(variance[active], variance[active]))
    off = np.abs(sub[~np.eye(len(sub), dtype=bool)])
    made = (n, int(active.sum()), float(np.exp(-(shares * np.log(shares)).sum())), float(off.mean()) if off.size else 0.0)
    return df.sparkSession.createDataFrame([made], schema)
