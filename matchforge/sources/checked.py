"""Checked writes and loads: assertions that are counted while rows are written, and caches that load only if they hold.

Metrics ride along with the write (`DataFrame.observe`), so a check costs no second scan. A cache publishes its description after its
rows are written and its checks have passed; without a description there is nothing to load.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FORMAT = 3
SPLITS = ("train", "test")


class CheckFailed(ValueError):
    """What rows did not meet; nothing was published."""


@dataclass(frozen=True)
class Check:
    """An aggregate of all rows and what its value has to be."""

    name: str
    value: Column
    holds: Callable[[object], bool]
    says: str


def in_range(column: str, low: float, high: float) -> Check:
    """No value outside low..high; nulls and NaN are outside."""
    c = F.col(column)
    return Check(f"{column}_range", F.count_if(~F.coalesce(c.between(low, high), F.lit(False))), lambda n: n == 0, f"{column} lies in {low}..{high}")


def binary(column: str) -> Check:
    return Check(f"{column}_binary", F.count_if(~F.coalesce(F.col(column).isin(0, 1), F.lit(False))), lambda n: n == 0, f"{column} is 0 or 1")


def both_outcomes(column: str, split: str, name: str) -> Check:
    """Where a split has rows, its label takes both values."""
    own = F.when(F.col(split) == name, F.col(column).cast("double"))
    return Check(f"{name}_{column}_outcomes", F.coalesce(F.max(own) > F.min(own), F.lit(True)), bool, f"{column} of {name} takes both values")


def length(column: str, n: int) -> Check:
    return Check(f"{column}_length", F.count_if(F.coalesce(F.size(column), F.lit(-1)) != n), lambda bad: bad == 0, f"{column} holds {n} values in every row")


def all_known(column: str, values) -> Check:
    return Check(f"{column}_known", F.count_if(~F.coalesce(F.col(column).isin(*values), F.lit(False))), lambda n: n == 0, f"{column} is one of {', '.join(map(str, values))}")


def rows_are(n: int) -> Check:
    return Check("rows", F.count(F.lit(1)), lambda held: held == n, f"there are {n} rows")


def checked(df: DataFrame, checks: list[Check], action: Callable[[DataFrame], object], more: dict[str, Column] | None = None) -> dict:
    """Run `action` (a write, or any full pass) on the rows and return the metrics; CheckFailed names every check that does not hold."""
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    metrics = {c.name: c.value for c in checks} | (more or {})
    action(df.observe(seen, *[v.alias(k) for k, v in metrics.items()]))
    got = seen.get
    failed = [f"{c.says} ({c.name}: {got[c.name]})" for c in checks if not c.holds(got[c.name])]
    if failed:
        raise CheckFailed("; ".join(failed))
    return got


def write_cache(df: DataFrame, path: str, label: str, arrays: dict[str, int], split: str = "split", splits: tuple = SPLITS, checks: list[Check] | None = None) -> dict:
    """Write games with arrays of fixed lengths, in a folder per split, and then their description.

    The label has to be binary and to take both values in every split, splits have to be known, arrays to have their lengths; `checks` adds
    more. Rows whose checks fail stay unpublished, and a cache that was there before stays as it is.
    """
    every = [all_known(split, splits), binary(label), *[both_outcomes(label, split, s) for s in splits], *[length(c, n) for c, n in arrays.items()], *(checks or [])]
    counts = {f"n_{s}": F.count_if(F.col(split) == s) for s in splits}
    folder = f"data-{uuid.uuid4().hex}"
    got = checked(df, every, lambda rows: rows.write.partitionBy(split).parquet(f"{path}/{folder}"), counts)
    meta = {"format": FORMAT, "folder": folder, "label": label, "split": split, "splits": {s: got[f"n_{s}"] for s in splits}, "arrays": arrays, "schema": df.schema.jsonValue()}
    fs, inside = pafs.FileSystem.from_uri(path)
    part = f"{inside}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(json.dumps(meta).encode())
    fs.move(part, f"{inside}/cache.json")
    return meta


def load_splits(spark: SparkSession, path: str, need: list[str] | None = None, defaults: dict[str, float] | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """The splits of a cache by name. `need`: arrays that must be there; `defaults`: arrays that are filled where the cache has none, by the value given.

    A cache of another format, without an array that is needed, or (with `verify`, which reads no columns) whose rows are not as many as its
    description says, is an error.
    """
    fs, inside = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{inside}/cache.json").type == pafs.FileType.NotFound:
        raise CheckFailed(f"{path} holds no finished cache")
    with fs.open_input_stream(f"{inside}/cache.json") as f:
        meta = json.loads(f.read())
    if meta["format"] != FORMAT:
        raise CheckFailed(f"the cache has format {meta['format']}, not {FORMAT}: write it again")
    missing = [c for c in need or [] if c not in meta["arrays"]]
    if missing:
        raise CheckFailed(f"the cache lacks {', '.join(missing)}")
    from pyspark.sql import types as T

    rows = spark.read.schema(T.StructType.fromJson(meta["schema"])).parquet(f"{path}/{meta['folder']}")
    games = max(meta["arrays"].values(), default=0)
    rows = rows.withColumns({c: F.array_repeat(F.lit(float(v)), games) for c, v in (defaults or {}).items() if c not in meta["arrays"]})
    out = {name: rows.where(F.col(meta["split"]) == name) for name in meta["splits"]}
    if verify:
        held = {name: df.count() for name, df in out.items()}
        if held != meta["splits"]:
            raise CheckFailed(f"the cache holds {held} rows, not {meta['splits']}")
    return out
