"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The rows are centred on their exact integer means. Every step makes one distributed pass over the rows: each task forms u = Xv
for its rows, their products with all earlier u (full reorthogonalisation), and its share of the transposed product; partial sums meet by
place. Earlier u are not stored: all of them are X times a vector of the row space, which the driver holds, so a lost
executor costs only its own tasks. The driver holds vectors of as many numbers as a row has, never rows.

The small bidiagonal matrix has the same singular values as the centred rows, and its right singular vectors combine the
steps' directions into components. The search goes on until all variance is found, or until the wanted components are exact to rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import small_batches, tidy, write_table
from matchforge.llm.topk_search import finite_vectors

#: Whole entries beyond this magnitude are taken as it: doubles and sums stay exact.
MOST = 1 << 52
_EPS = 2.0**-52


def whole_vectors(vectors: DataFrame, scale: int, offset: int, id_col: str, vector: str) -> DataFrame:
    """vec_id, x: floor(scale * c) + offset of the finite vectors of the most frequent length (of ties, the smallest)."""
    rows = finite_vectors(vectors, id_col, vector)
    limit = F.lit(float(MOST))
    x = F.transform("parts", lambda c: F.floor(F.greatest(-limit, F.least(limit, c * scale))) + offset)
    rows = write_table(rows.select("vec_id", "dims", x.alias("x")), "whole-vectors")
    best = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.col("dims") == (best.dims if best else 0)).select("vec_id", "x")


def _matrix(column):
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def summed(rows: DataFrame, part) -> list:
    """Element-wise sum over all rows of the arrays that `part` makes of matrices of x (None: nothing yet), as doubles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                now = part(_matrix(batch.column(0)))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, np.float64)], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("x").mapInArrow(tidy(run), "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    return [r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()]


class Centre:
    """Exact means of integer columns: whole part and remainder over n."""

    def __init__(self, n: int, sums: list):
        import numpy as np

        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x):
        """x - S / n as doubles; no digit is lost to the size of x."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x) -> list:
        """Sums of (n * x - S)^2 as integers; None where 64 bits do not hold them."""
        import numpy as np

        near = x - self.whole
        top = int(np.abs(near).max(initial=0)) * self.n + self.n
        if top * top * max(1, x.shape[1]) < 1 << 63:
            d = near * self.n - self.rest
            return (d * d).sum(axis=1).tolist()
        rest = self.rest.tolist()
        out = [sum((a * self.n - b) ** 2 for a, b in zip(r, rest)) for r in near.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def centre_of(rows: DataFrame) -> Centre | None:
    """Means over the rows, from exact sums; None without rows."""
    n = rows.count()
    if not n:
        return None

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                now = [sum(c) for c in _matrix(batch.column(0)).T.tolist()]
                total = now if total is None else [a + b for a, b in zip(total, now)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], ["sums"])

    parts = rows.select("x").mapInArrow(tidy(run), "sums array<string>").select(F.posexplode("sums").alias("at", "v"))
    sums = parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at").collect()
    return Centre(n, [int(r.v) for r in sums])


def _fresh(known, d: int, seed: int):
    """A unit vector orthogonal to the known ones."""
    import numpy as np

    v = np.random.default_rng(seed).standard_normal(d)
    for _ in range(3):
        for w in known:
            v = v - w * (w @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(rows: DataFrame, centre: Centre, wanted: int):
    """(components as rows, singular values, total of squares) of the centred rows, by falling singular value."""
    import numpy as np

    d = len(centre.sums)
    total = summed(rows, lambda x: (centre.centred(x) ** 2).sum(axis=0))
    energy = float(sum(total))
    right, combos, images, alphas, betas = [], [], [], [], []  # v, w with u = Xw, X'u
    if energy == 0:
        return np.zeros((0, d)), np.zeros(0), 0.0
    scale = energy**0.5
    v = _fresh([], d, 7)
    beta = 0.0
    while True:
        k = len(right)
        raw = v - (beta * combos[-1] if k and beta else 0)
        before = np.array(combos).reshape(k, d).T

        def step(x, raw=raw, before=before):
            c = centre.centred(x)
            u = c @ raw
            return np.concatenate([c.T @ u, (c @ before).T @ u, [u @ u]])

        got = np.array(summed(rows, step))
        image, along, square = got[:d], got[d:-1], got[-1]
        square -= along @ along
        alpha = float(square) ** 0.5 if square > 0 else 0.0
        right.append(v)
        if alpha > 4 * d * _EPS * scale:
            combos.append((raw - before @ along) / alpha)
            images.append((image - np.array(images).reshape(k, d).T @ along) / alpha)
        else:
            alpha = 0.0  # v adds no direction of the rows
            combos.append(np.zeros(d))
            images.append(np.zeros(d))
        alphas.append(alpha)
        k += 1
        if k == d:
            betas.append(0.0)
        else:
            after = images[-1] - alpha * v
            for _ in range(2):
                for w in right:
                    after = after - w * (w @ after)
            beta = float(np.linalg.norm(after))
            if beta > 4 * d * _EPS * scale:
                v = after / beta
            else:
                beta, v = 0.0, _fresh(right, d, 7 + k)
            betas.append(beta)
        small = np.diag(alphas) + np.diag(betas[: k - 1], 1)
        left, sigma, q = np.linalg.svd(small)
        found = float(sum(sigma**2))
        unsure = betas[-1] * np.abs(left[-1, :wanted])
        if k == d or energy - found <= 4 * d * _EPS * energy or (k > 2 * wanted and beta and (unsure <= 4 * _EPS * sigma[0]).all()):
            return q @ np.array(right), sigma, energy


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors that are null or hold null, NaN or infinite components take no part; nor do those whose length is not the most frequent
    one. Entries become floor(scale * c) + offset, at most 2^52 in size. The components are fitted on each distinct vector
    once, so copies weigh nothing; n is their number. Directions without variance beyond rounding have no component: an
    empty table, or equal vectors only, give an empty result. `deviation` is null where 64 bits do not hold it. Rows with a null id or
    repeated rows are rows of their own.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = whole_vectors(vectors, scale, offset, id_col, vector)
    fit = write_table(rows.select("x").distinct(), "fit-list")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    centre = centre_of(fit)
    if centre is None or not centre.sums:
        return spark.createDataFrame([], schema)
    import numpy as np

    axes, sigma, energy = bidiagonalise(fit, centre, components)
    m = min(components, int((sigma > 1e-7 * sigma[:1].sum()).sum()))
    if not m:
        return spark.createDataFrame([], schema)
    explained = sigma[:m] ** 2 / energy
    project = axes[:m].T / (sigma[:m] / centre.n**0.5)
    mean = np.array(summed(fit, lambda x: (centre.centred(x) @ project).sum(axis=0))) / centre.n

    def spread(x):
        w = centre.centred(x) @ project - mean
        return (w.T @ w).ravel()

    error = float(np.abs(np.array(summed(fit, spread)).reshape(m, m) / centre.n - np.eye(m)).max())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m)))
                deviation = [v for v in centre.deviations(x) for _ in range(m)]
                k = len(x)
                cols = [ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, centre.n)), pa.array(deviation, pa.int64()), pa.array((centre.centred(x) @ project).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), schema)
