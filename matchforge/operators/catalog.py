"""Build catalogues: which builds a champion and role play, with smoothed shares; joint worlds and scores over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def prior_vectors(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build shares of a role, and of all roles; `counts`: championid, teamposition, build, n."""
    role = counts.groupBy("teamposition", "build").agg(F.sum("n").alias("n"))
    role = role.select("teamposition", "build", (F.col("n") / F.sum("n").over(Window.partitionBy("teamposition"))).alias("role_share"))
    every = counts.groupBy("build").agg(F.sum("n").alias("n"))
    every = every.crossJoin(every.agg(F.sum("n").alias("all"))).select("build", (F.col("n") / F.col("all")).alias("global_share"))
    return role, every


def build_catalog(counts: DataFrame, least: int = 20, least_share: float = 0.01, tau: float = 20.0, core: int = 50, core_share: float = 0.02) -> DataFrame:
    """Retained builds of each (champion, role): n, share, retained_mass, p, tier.

    p = (n + tau * q) / (N + tau) over retained builds; q is the role's share of them, made to sum to 1 (uniform if it is 0).
    """
    slot = Window.partitionBy("championid", "teamposition")
    role, _ = prior_vectors(counts)
    all_n = counts.withColumn("total", F.sum("n").over(slot)).withColumn("share", F.col("n") / F.col("total"))
    kept = all_n.where((F.col("n") >= least) & (F.col("share") >= least_share)).join(role, ["teamposition", "build"], "left")
    kept = kept.withColumn("kept_n", F.sum("n").over(slot)).withColumn("mass", F.sum("role_share").over(slot)).withColumn("kept_builds", F.count("*").over(slot))
    q = F.when(F.col("mass") > 0, F.col("role_share") / F.col("mass")).otherwise(1.0 / F.col("kept_builds"))
    tier = F.when((F.col("n") >= core) & (F.col("share") >= core_share), "core").otherwise("tail")
    return kept.select("championid", "teamposition", "build", "n", "share", (F.col("kept_n") / F.col("total")).alias("retained_mass"), ((F.col("n") + tau * q) / (F.col("kept_n") + tau)).alias("p"), tier.alias("tier"))


def modal_build(catalog: DataFrame) -> DataFrame:
    """The likeliest build of each (champion, role), the first by name on ties."""
    place = F.row_number().over(Window.partitionBy("championid", "teamposition").orderBy(F.desc("p"), "build"))
    return catalog.withColumn("_i", place).where("_i = 1").select("championid", "teamposition", F.col("build").alias("modal_build"), "p")


def eligibility_pool(catalog: DataFrame) -> DataFrame:
    """Core builds weighed by their probability times the role's share among the champion's games."""
    slot = catalog.groupBy("championid", "teamposition").agg(F.sum("n").alias("slot_n"))
    slot = slot.withColumn("role_share", F.col("slot_n") / F.sum("slot_n").over(Window.partitionBy("championid")))
    return catalog.where("tier = 'core'").join(slot, ["championid", "teamposition"]).select("championid", "teamposition", "build", (F.col("p") * F.col("role_share")).alias("weight"))


def _merged(a, b, width: int):
    """The `width` largest products of two falling lists of weights, with the places they come from; one row per game.

    The pair at (i, j) has (i + 1)(j + 1) - 1 pairs at least as large, so only pairs with (i + 1)(j + 1) <= width can be among them:
    width * log(width) pairs, not width^2.
    """
    import numpy as np

    n, m = a.shape[1], b.shape[1]
    if n * m <= 4 * width:
        i, j = np.divmod(np.arange(n * m), m)
    else:
        take = np.minimum(m, width // np.arange(1, min(n, width) + 1))
        i = np.repeat(np.arange(len(take)), take)
        j = np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
    made = a[:, i] * b[:, j]
    best = np.argsort(-made, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(made, best, 1), i[best], j[best]


def _choices(slots: list, width: int):
    """(weights, choices) of games of one shape: `slots` has one array per slot, a row of falling probabilities per game."""
    import numpy as np

    small = np.int16 if max(p.shape[1] for p in slots) < 2**15 else np.int32
    held = [(p[:, :width], np.broadcast_to(np.arange(min(p.shape[1], width), dtype=small)[None, :, None], (len(p), min(p.shape[1], width), 1))) for p in slots]
    while len(held) > 1:
        pairs = []
        for x, y in zip(held[::2], held[1::2]):
            w, i, j = _merged(x[0], y[0], width)
            pairs.append((w, np.concatenate([np.take_along_axis(x[1], i[:, :, None], 1), np.take_along_axis(y[1], j[:, :, None], 1)], axis=2)))
        held = pairs + ([held[-1]] if len(held) % 2 else [])
    return held[0]


def top_choices(slots: list, width: int):
    """(weights, choices): the `width` joint choices of the largest products, one column of choices per slot, by falling weight.

    `slots` are falling arrays of probabilities; halves are merged in a tree.
    """
    import numpy as np

    if not slots or any(len(p) == 0 for p in slots):
        return np.zeros(0), np.zeros((0, len(slots)), np.int64)
    weights, chosen = _choices([np.asarray(p, np.float64)[None, :] for p in slots], width)
    return weights[0], chosen[0].astype(np.int64)


def game_worlds(games: DataFrame, slots: str = "slots", k: int = 3, width: int = 512, stop: float = 0.9) -> DataFrame:
    """joint_worlds with one row per game: game columns, choices (per slot its builds, likeliest first), weights and picks.

    World w has weights[w] and takes, of each slot, the choice that the w-th stretch of picks names. Games of one shape (the number
    of choices of each slot) are worked on together. Narrow: a game's worlds are made where it stands.
    """
    likely = lambda slot: F.slice(F.sort_array(F.transform(F.filter(slot, lambda x: x["p"] > 0), lambda x: F.struct((-x["p"]).alias("p"), x["build"].cast("string").alias("build")))), 1, k)
    keys = [c for c in games.columns if c != slots]
    held = games.where(F.col(slots).isNotNull()).select(*keys, F.transform(slots, likely).alias("_slots"))
    held = held.select(*keys, F.transform("_slots", lambda x: x["build"]).alias("choices"), F.transform("_slots", lambda x: x["p"]).alias("_p"))
    schema = T.StructType(held.schema.fields[:-1]).add("weights", T.ArrayType(T.DoubleType())).add("picks", T.ArrayType(T.IntegerType()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            every = batch.column(len(keys) + 1)
            outer, inner = every.offsets.to_numpy(), every.values.offsets.to_numpy()
            p, sizes = -every.values.values.to_numpy(zero_copy_only=False), np.diff(inner)
            shapes = {}
            for g in range(batch.num_rows):
                shapes.setdefault(sizes[outer[g] : outer[g + 1]].tobytes(), []).append(g)
            for members in shapes.values():
                first, last = outer[members[0]], outer[members[0] + 1]
                shape = sizes[first:last]
                if not len(shape) or not shape.all():
                    continue
                # a few million products at a time
                step = max(1, 2_000_000 // min(int(np.prod(shape.astype(float))), width * 16))
                for at in range(0, len(members), step):
                    mine = np.asarray(members[at : at + step])
                    starts = inner[outer[mine][:, None] + np.arange(len(shape))]
                    found, chosen = _choices([p[starts[:, s, None] + np.arange(n)] for s, n in enumerate(shape)], width)
                    kept = np.minimum((np.cumsum(found, axis=1) < stop).sum(axis=1) + 1, found.shape[1])
                    inside = np.arange(found.shape[1]) < kept[:, None]
                    ends = np.concatenate([[0], np.cumsum(kept)])
                    weights = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[inside]))
                    picks = pa.ListArray.from_arrays(pa.array(ends * len(shape), pa.int32()), pa.array(chosen[inside].ravel(), pa.int32()))
                    rows = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keys) + 1)), weights, picks], [f.name for f in schema.fields])

    return held.mapInArrow(run, schema)


def joint_worlds(games: DataFrame, slots: str = "slots", k: int = 3, width: int = 512, stop: float = 0.9) -> DataFrame:
    """Most likely joint choices, one row per world: game columns, world (from 0), builds, weight.

    `slots` is an array, per slot, of arrays of (build, p), any number of them. Each slot keeps its `k` likeliest choices (ties by build);
    of their products the `width` largest are found exactly. Worlds are kept until their mass reaches `stop`, the one that crosses
    it included; weights are not scaled. Choices of no mass are dropped; a game with a slot that has none, or without slots, has no
    world. See game_worlds where a row per game will do.
    """
    keys = [c for c in games.columns if c != slots]
    rows = game_worlds(games, slots, k, width, stop).select(*keys, "choices", "picks", F.posexplode("weights").alias("world", "weight"))
    mine = F.slice("picks", F.col("world") * F.size("choices") + 1, F.size("choices"))
    return rows.select(*keys, "world", F.zip_with("choices", mine, lambda c, i: c[i]).alias("builds"), "weight")


def fallback_counts(slots: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """fallback_source, n: how many slots took their choices from each source; slots that no vector covers count as 'none'."""
    sources = vectors.select(*keys, "fallback_source").distinct()
    return slots.join(sources, keys, "left").groupBy(F.coalesce("fallback_source", F.lit("none")).alias("fallback_source")).agg(F.count("*").alias("n"))


def marginalise(scored: DataFrame, game: str, weight: str = "weight", score: str = "score", floor: float = 0.5) -> DataFrame:
    """Score of a game over its worlds: sum of weight * score over the sum of weights, the mass, and whether it is low."""
    out = scored.groupBy(game).agg((F.sum(F.col(weight) * F.col(score)) / F.sum(weight)).alias("score"), F.sum(weight).alias("retained_mass"), F.count("*").alias("worlds"))
    return out.withColumn("low_confidence", (F.col("retained_mass") < floor).cast("int"))


def prior_vector(roles: DataFrame, role_counts: DataFrame, all_counts: DataFrame) -> DataFrame:
    """Share of every build in each role of `roles`: the role's own vector, or the one over all roles where it has none (fallback_source)."""
    role, _ = prior_vectors(role_counts)
    _, every = prior_vectors(all_counts)
    given = role.select("teamposition").distinct().withColumn("_given", F.lit(1))
    wide = roles.crossJoin(every).join(role, ["teamposition", "build"], "left").join(given, "teamposition", "left")
    own = F.col("_given").isNotNull()
    share = F.when(own, F.coalesce("role_share", F.lit(0.0))).otherwise(F.col("global_share"))
    return wide.select("teamposition", "build", share.alias("share"), F.when(own, "role").otherwise("global").alias("fallback_source"))


def content_version(catalog: DataFrame, columns: list[str]) -> DataFrame:
    """One row: version, a digest that follows from the rows, not from their order or files.

    Digests of rows are added up, so partial sums are made before anything is shuffled.
    """
    row = F.sha1(F.to_json(F.struct(*columns)))
    part = lambda i: F.sum(F.conv(F.substring(row, 10 * i + 1, 10), 16, 10).cast("decimal(38,0)"))
    sums = catalog.agg(*[part(i).alias(f"p{i}") for i in range(4)], F.count("*").alias("n"))
    return sums.select(F.sha1(F.concat_ws(":", "n", *[F.col(f"p{i}").cast("string") for i in range(4)])).alias("version"), "n")


def apply_modal(rows: DataFrame, modal: DataFrame, priors: DataFrame, defaults: dict) -> DataFrame:
    """Rows with the modal build of their champion and role (their own where there is none) and the priors of that build."""
    out = rows.join(modal.select("championid", "teamposition", "modal_build"), ["championid", "teamposition"], "left")
    out = out.withColumn("build", F.coalesce("modal_build", "build")).drop("modal_build", *defaults)
    out = out.join(priors.select("championid", "teamposition", "build", *defaults), ["championid", "teamposition", "build"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
