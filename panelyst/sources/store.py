"""Tables that are merged by key: a merge writes only the buckets it touches, and one manifest switches all tables at once.

A folder has ``manifests/<version>.json``, which names the folders of every bucket of every table and the last batch that each
stream has put in, and ``<table>/v=<version>-<id>/bucket=<b>`` with Parquet files. A run that stops before its manifest is in
place leaves the tables as they were; one that stops after it has done all. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Merge:
    """Rows to put into a table. Old rows with a key of ``rows``, or of ``replaced`` if given (one column, the key), go; columns in
    ``keep`` keep their old value where a row of that key was there."""

    rows: DataFrame
    replaced: DataFrame | None = None
    keep: tuple[str, ...] = ()


def upserted(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), replaced: DataFrame | None = None) -> DataFrame:
    """Old rows but for those that new ones replace; columns in ``keep`` keep their old value, such as a human's review."""
    cols = old.columns
    if keep:
        was = old.select(F.col(key).alias("was_key"), F.struct(*keep).alias("was")).alias("w")
        joined = new.alias("n").join(was, F.col(f"n.{key}") == F.col("w.was_key"), "left")
        new = joined.select(*[F.coalesce(F.col(f"w.was.{c}"), F.col(f"n.{c}")).alias(c) if c in keep else F.col(f"n.{c}").alias(c) for c in cols])
    gone = new.select(key) if replaced is None else replaced.select(key)
    return old.join(gone, key, "left_anti").select(*cols).unionByName(new.select(*cols))


class Store:
    """Tables under a folder, each with a key column; ``buckets`` holds for tables made from now on."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    # ------------------------------------------------------------------ manifests

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The latest manifest, or that of a version; of a new store an empty one."""
        known = self._versions()
        if not known:
            return {"version": 0, "tables": {}, "batches": {}}
        at = self._at("manifests", f"{known[-1] if version is None else version}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """A file is written whole under another name before it gets its own, so a manifest is there whole or not at all."""
        name = f"{manifest['version']}.json"
        staged, final = self._at("manifests", f".{name}.{uuid.uuid4().hex}"), self._at("manifests", name)
        stream = self._fs.create(staged, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"another writer has put version {manifest['version']} into {self.path}")

    # ------------------------------------------------------------------ reading

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the tables, -1 if there is none."""
        return self.manifest()["batches"].get(stream, -1)

    def read(self, table: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
        """A table as of the latest or a given version; one that was never written is empty and needs ``schema``."""
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            return self.spark.createDataFrame([], schema)
        return self._folders(table, entry, list(entry["folders"]))

    def _folders(self, table: str, entry: dict, wanted: list[str]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = ["/".join([self.path, table, entry["folders"][b]]) for b in wanted if b in entry["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------------ merging

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")).cast("int")

    def merge(self, merges: dict[str, Merge], batch: tuple[str, int] | None = None) -> bool:
        """Put rows into tables, all at once; with ``batch``, a stream's name and number, nothing if that batch is in already."""
        now = self.manifest()
        if batch is not None and batch[1] <= now["batches"].get(batch[0], -1):
            return False
        version = now["version"] + 1
        tables = dict(now["tables"])
        for table, m in merges.items():
            tables[table] = self._merged(table, tables.get(table), m, version)
        batches = now["batches"] | ({batch[0]: batch[1]} if batch is not None else {})
        self._commit({"version": version, "tables": tables, "batches": batches})
        return True

    def _merged(self, table: str, entry: dict | None, m: Merge, version: int) -> dict:
        key = self.keys[table]
        entry = entry or {"schema": m.rows.schema.jsonValue(), "buckets": self.buckets, "folders": {}}
        at = self._bucket(F.col(key), entry["buckets"])
        replaced = m.rows if m.replaced is None else m.replaced
        # as many numbers as there are buckets at most
        touched = sorted({r[0] for df in (m.rows, replaced) for r in df.select(at.alias("b")).distinct().collect()})
        if not touched:
            return entry
        old = self._folders(table, entry, [str(b) for b in touched])
        rows = upserted(old, m.rows.select(*old.columns), key, m.keep, m.replaced).withColumn("bucket", at)
        name = f"v={version}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet("/".join([self.path, table, name]))
        made = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._at(table, name)) if s.isDirectory()}
        folders = {b: f for b, f in entry["folders"].items() if int(b) not in touched}
        folders |= {b: f"{name}/bucket={b}" for b in made if b.isdigit()}
        return entry | {"folders": folders}

    def vacuum(self, versions: int = 2) -> int:
        """Delete manifests but the last ``versions``, and the folders that none of these names; returns how many folders went.
        What a stopped run left goes too, so no other run may be writing."""
        known = self._versions()
        stay = [self.manifest(v) for v in known[-versions:]]
        for v in known[:-versions]:
            self._fs.delete(self._at("manifests", f"{v}.json"), False)
        gone = 0
        for table in self.keys:
            if not self._fs.exists(self._at(table)):
                continue
            named = {f for s in stay for f in s["tables"].get(table, {"folders": {}})["folders"].values()}
            for version in self._fs.listStatus(self._at(table)):
                name = version.getPath().getName()
                for bucket in self._fs.listStatus(version.getPath()) if version.isDirectory() else ():
                    if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in named:
                        gone += self._fs.delete(bucket.getPath(), True)
                if not any(f.startswith(f"{name}/") for f in named):
                    self._fs.delete(version.getPath(), True)
        return gone
