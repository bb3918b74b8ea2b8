"""Rows in hash buckets: Parquet folders that a snapshot names.

A write puts its files into a folder of its own and then names them in a new snapshot, one small JSON
file that appears at once by a rename. A reader keeps the snapshot that it began with: what a later
write replaces is a new folder, never a file that is being read. Only buckets that hold replaced rows
are written again; the others gain files or stay. Files that no snapshot names are removed by
vacuum(), when no reader needs them any more. A write may carry the number of a stream's batch: a batch
that a snapshot holds already writes nothing.

One writer at a time is expected; a second one that began with the same snapshot fails with Conflict.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Files

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another write has made the next snapshot first."""


def bucket_of(key: str | Column, buckets: int) -> Column:
    """The bucket of a value; crc32 of its text, so that a driver can name the buckets of known values."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string")) % buckets, F.lit(0)).cast("int")


class BucketTable:
    """A table below `root` in buckets by `bucket`, a column expression of its rows."""

    def __init__(self, spark: SparkSession, root: str, bucket: Column, sort: tuple[str, ...] = ()):
        self.spark, self.root, self.bucket, self.sort, self.files = spark, root.rstrip("/"), bucket, list(sort), Files(spark)

    # snapshots -------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest snapshot's number, 0 without any."""
        return max(self.versions(), default=0)

    def snapshot(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "folders": {}, "stats": {}, "batches": {}}
        return json.loads(self.files.read(f"{self.root}/snapshots/{version}.json"))

    def _commit(self, old: dict, **new) -> dict:
        now = {**old, **new, "version": old["version"] + 1}
        path = f"{self.root}/snapshots/{now['version']}.json"
        self.files.write(aside := f"{self.root}/snapshots/.{uuid.uuid4().hex}", json.dumps(now))
        if not self.files.rename_new(aside, path):
            raise Conflict(f"snapshot {now['version']} of {self.root} exists")
        return now

    @staticmethod
    def added(before: dict, after: dict) -> dict:
        """A snapshot of the folders that a write has added: its rows, and what it wrote again."""
        return {**after, "folders": {b: [f for f in own if f not in before["folders"].get(b, [])] for b, own in after["folders"].items()}}

    # reading ---------------------------------------------------------------------------------

    def paths(self, buckets: list[int] | None = None, snapshot: dict | None = None) -> list[str]:
        """Folders that hold the rows of some buckets, or of all."""
        folders = (snapshot or self.snapshot())["folders"]
        own = folders if buckets is None else [str(b) for b in sorted(set(buckets)) if str(b) in folders]
        return [f"{self.root}/data/{f}/{BUCKET}={b}" for b in own for f in folders[b]]

    def read(self, buckets: list[int] | None = None, snapshot: dict | None = None) -> DataFrame | None:
        """Rows of some buckets, or of all; None if nothing was ever written."""
        snapshot = snapshot or self.snapshot()
        if snapshot["schema"] is None:
            return None
        schema, paths = StructType.fromJson(json.loads(snapshot["schema"])), self.paths(buckets, snapshot)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new folder with the rows, and its buckets. A large bucket becomes several files, small ones share a task."""
        name = f"{uuid.uuid4().hex}"
        out = rows.withColumn(BUCKET, self.bucket).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.sort)
        out.write.partitionBy(BUCKET).parquet(f"{self.root}/data/{name}")
        return name, [n.split("=")[1] for n in self.files.folders(f"{self.root}/data/{name}") if n.startswith(BUCKET)]

    def _schema(self, old: dict, rows: DataFrame) -> str:
        """Columns known so far, then new ones; all may be null."""
        known = StructType.fromJson(json.loads(old["schema"])) if old["schema"] else StructType()
        fields = {f.name: f for f in known}
        for f in rows.schema:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in {self.root}, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, f)
        return StructType([type(f)(f.name, f.dataType, True) for f in fields.values()]).json()

    def _seen(self, old: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and old["batches"].get(batch[0], -1) >= batch[1]

    def write(self, rows: DataFrame, *, gone: DataFrame | None = None, on: str = "", batch: tuple[str, int] | None = None, stats: dict | None = None, fresh: bool = False, more: list[tuple[str, list[str]]] | None = None) -> dict:
        """Add rows, and the folders `more` that _write() has made, in one commit; first drop those whose `on` is in gone(on), by writing their buckets again. `fresh` leaves out all that was there.

        `on` must be what the bucket is made from. `stats` are kept with the snapshot. Returns the snapshot; a write without rows that changes nothing makes none.
        """
        old = self.snapshot()
        if self._seen(old, batch):
            return old
        batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
        schema = rows.schema if fresh else None
        folders = {} if fresh else {b: list(f) for b, f in old["folders"].items()}
        if gone is not None and folders:
            # at most as many numbers as there are buckets
            touched = [r[0] for r in gone.select(self.bucket.alias(BUCKET)).distinct().collect() if str(r[0]) in folders]
            if touched:
                rows = rows.unionByName(self.read(touched, old).join(gone.select(on).distinct(), on, "left_anti"), allowMissingColumns=True)
                folders = {b: f for b, f in folders.items() if int(b) not in touched}
        name, buckets = self._write(rows)
        if old["version"] and not (buckets or more or stats or fresh) and folders == old["folders"]:
            self.files.remove(f"{self.root}/data/{name}")
            return old
        for one, own in [(name, buckets), *(more or [])]:
            for b in own:
                folders.setdefault(b, []).append(one)
        json_schema = StructType([type(f)(f.name, f.dataType, True) for f in schema]).json() if schema is not None else self._schema(old, rows)
        return self._commit(old, schema=json_schema, folders=folders, batches=batches, stats=old["stats"] | stats if stats else old["stats"])

    def compact(self, most: int = 1) -> dict:
        """Buckets of more than `most` folders as one."""
        old = self.snapshot()
        many = [int(b) for b, f in old["folders"].items() if len(f) > most]
        if not many:
            return old
        name, buckets = self._write(self.read(many, old))
        folders = {b: f for b, f in old["folders"].items() if int(b) not in many} | {b: [name] for b in buckets}
        return self._commit(old, folders=folders)

    def vacuum(self, keep: int = 1) -> int:
        """Remove snapshots but the newest `keep`, and the folders that none of these names; how many folders."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for own in self.snapshot(v)["folders"].values() for f in own}
        for v in versions[:-keep]:
            self.files.remove(f"{self.root}/snapshots/{v}.json")
        dead = [f for f in self.files.folders(f"{self.root}/data") if f not in live]
        for f in dead:
            self.files.remove(f"{self.root}/data/{f}")
        return len(dead)
