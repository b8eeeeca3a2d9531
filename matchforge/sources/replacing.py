"""Replacing tables: of rows with equal sort keys the newest version stays, under copy-on-write.

Rows live in slices: a hash bucket of the sort key, inside a partition where one is named. A write makes new files of the
slices it touches only and publishes a manifest (which folder holds each slice) by one rename. Readers hold on to
one manifest, so they see one version; a write that dies leaves files that no manifest names, which `vacuum` removes.
One writer at a time: a second one that publishes the same number fails.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = re.compile(r"manifest-(\d{9})\.json")


class ReplacingTable:
    """A table under `path` (a folder all machines share) with rows unique by `key`.

    `version`: columns whose greatest values win among rows of equal keys (nulls lose; of full ties, one row by its contents).
    `partition`: text that follows from key columns, such as a day; reads by partition open its folders only. Without
    `version`, the row of the later write wins. Keys may hold nulls, which are equal to each other.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], version: list[str] | None = None, partition: Column | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.version, self.partition, self.buckets = spark, path.rstrip("/"), key, version or [], partition, buckets

    # -- manifests

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path)

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first."""
        fs, path = self._fs()
        found = [_MANIFEST.fullmatch(f.base_name) for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))]
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, number: int | None = None) -> dict:
        numbers = self.versions()
        if not numbers and number is None:
            return {"number": 0, "buckets": self.buckets, "schema": None, "slices": {}}
        fs, path = self._fs()
        with fs.open_input_stream(f"{path}/manifest-{numbers[-1] if number is None else number:09d}.json") as f:
            held = json.loads(f.read())
        self.buckets = held["buckets"]
        return held

    def _publish(self, old: dict, schema: T.StructType, slices: dict) -> int:
        fs, path = self._fs()
        fs.create_dir(path, recursive=True)
        number = old["number"] + 1
        name, part = f"{path}/manifest-{number:09d}.json", f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(json.dumps({"number": number, "buckets": self.buckets, "schema": schema.jsonValue(), "slices": slices}).encode())
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_file(part)
            raise RuntimeError(f"version {number} of {self.path} was published by another writer")
        fs.move(part, name)
        return number

    # -- slices

    def _slice(self) -> Column:
        """Name of a row's slice; the partition is part of it."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")
        if self.partition is None:
            return bucket
        return F.concat(F.hex(F.coalesce(self.partition.cast("string"), F.lit(""))), F.lit("-"), bucket)

    def _folder(self, slices: dict, name: str) -> str:
        return f"{self.path}/{slices[name]}/_slice={name}"

    def _scan(self, held: dict, names, schema: T.StructType) -> DataFrame:
        folders = [self._folder(held["slices"], n) for n in sorted(names)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _write(self, rows: DataFrame) -> tuple[str, set]:
        """Write rows by slice into a new folder: its name, and the slices that got rows."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_slice", self._slice()).repartition("_slice").write.partitionBy("_slice").parquet(f"{self.path}/{name}")
        fs, path = self._fs()
        found = fs.get_file_info(pafs.FileSelector(f"{path}/{name}"))
        return name, {f.base_name.removeprefix("_slice=") for f in found if f.base_name.startswith("_slice=")}

    def _newest(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One row per key; greatest (version, age) wins. Rows are combined before they are shuffled, so no key is too hot."""
        row = F.struct(*columns)
        best = F.max_by(row, F.struct(*self.version, "_age", F.xxhash64(F.to_json(row))))
        return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.key]).agg(best.alias("_row")).select("_row.*")

    def _touched(self, rows: DataFrame) -> set:
        return {r[0] for r in rows.select(self._slice()).distinct().collect()}  # at most the table's slices

    # -- the table

    def merge(self, rows: DataFrame) -> int:
        """Add rows, replacing those of equal keys; only slices that rows fall into are written anew. Returns the version."""
        held = self._manifest()
        schema = rows.schema if held["schema"] is None else T.StructType.fromJson(held["schema"])
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
        touched = self._touched(rows)
        old = self._scan(held, touched & set(held["slices"]), schema)
        both = old.withColumn("_age", F.lit(0)).unionByName(rows.withColumn("_age", F.lit(1)))
        name, made = self._write(self._newest(both, schema.fieldNames()))
        return self._publish(held, schema, held["slices"] | dict.fromkeys(made, name))

    def replace_all(self, rows: DataFrame) -> int:
        """Truncate and insert as one step: readers see the old rows or the new ones. Rows of equal keys are one row."""
        held = self._manifest()
        name, made = self._write(self._newest(rows.withColumn("_age", F.lit(1)), rows.columns))
        return self._publish(held, rows.schema, dict.fromkeys(made, name))

    def delete(self, where: Column | DataFrame) -> int:
        """Delete rows that meet a predicate, or whose values are in a table of some of the columns (nulls match nulls)."""
        held = self._manifest()
        if held["schema"] is None:
            return 0
        schema = T.StructType.fromJson(held["schema"])
        rows = self.read()
        if isinstance(where, DataFrame):
            gone = where.distinct().withColumnsRenamed({c: f"_d_{c}" for c in where.columns})
            same = F.lit(True)
            for c in where.columns:
                same = same & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
            pick = lambda df, how: df.join(gone, same, how)
        else:
            pick = lambda df, how: df.where(where if how == "left_semi" else ~F.coalesce(where, F.lit(False)))
        by_key = isinstance(where, DataFrame) and set(self.key) <= set(where.columns)
        touched = self._touched(where if by_key else pick(rows, "left_semi")) & set(held["slices"])
        name, made = self._write(pick(self._scan(held, touched, schema), "left_anti"))
        slices = {k: v for k, v in held["slices"].items() if k not in touched}
        return self._publish(held, schema, slices | dict.fromkeys(made, name))

    def read(self, version: int | None = None, partitions: list | None = None) -> DataFrame:
        """All rows of a version (the newest if None), or those of some partitions, whose folders alone are opened."""
        held = self._manifest(version)
        if held["schema"] is None:
            raise ValueError(f"{self.path} holds no version")
        names = set(held["slices"])
        if partitions is not None:
            wanted = {str(p).encode().hex().upper() for p in partitions}
            names = {n for n in names if n.rpartition("-")[0] in wanted}
        return self._scan(held, names, T.StructType.fromJson(held["schema"]))

    def latest_run(self, run: str, stamp: str) -> DataFrame:
        """Rows of the run with the greatest stamp (of equal stamps, the greatest run): the reader of per-run snapshots."""
        rows = self.read()
        newest = rows.agg(F.max(F.struct(stamp, run)).alias("_m")).select(F.col(f"_m.{run}").alias("_run"))
        return rows.join(newest, F.col(run) == F.col("_run"), "left_semi")

    def vacuum(self, keep: int = 1) -> int:
        """Remove files that none of the newest `keep` versions names, and older manifests; returns the number of folders removed."""
        fs, path = self._fs()
        numbers = self.versions()
        live = {f"{folder}/_slice={name}" for n in numbers[-keep:] for name, folder in self._manifest(n)["slices"].items()}
        for n in numbers[:-keep]:
            fs.delete_file(f"{path}/manifest-{n:09d}.json")
        removed = 0
        for folder in fs.get_file_info(pafs.FileSelector(path)):
            if folder.base_name.startswith("data-"):
                inside = fs.get_file_info(pafs.FileSelector(folder.path))
                dead = [f for f in inside if f.base_name.startswith("_slice=") and f"{folder.base_name}/{f.base_name}" not in live]
                held = sum(f.base_name.startswith("_slice=") for f in inside)
                for f in [folder] if len(dead) == held else dead:
                    fs.delete_dir(f.path)
                removed += len(dead)
        return removed
