"""Versioned Parquet snapshots behind one manifest file: all of a run is seen, or none of it.

A version is written to a folder of its own and becomes current when the manifest that names it is moved into
place through Hadoop's file system, which works wherever Spark can write. A lock file keeps other writers out.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, BUCKET = 64, "_bucket"
STAGES = ("source_ready", "preparing_candidates", "matching_evidence", "evidence_ready", "failed")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. Without one in the session's settings a local session
    gets a temporary folder; on a cluster that would be each machine's own, so it is refused."""
    key = "spark.checkpoint.dir"
    top = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{key} has to name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: what follows starts from there, however often it is read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


class Busy(RuntimeError):
    """Another run holds the store."""


def config_hash(config) -> str:
    """SHA-256 of a configuration's canonical JSON: keys in order, finite numbers only."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def check_counters(report: dict) -> dict:
    """The report, if its counters are whole and none is negative and they add up."""
    if any(not isinstance(v, int) or v < 0 for v in report.values()):
        raise ValueError("counters are whole numbers of 0 or more")
    if report["processed"] != report["inserted"] + report["updated"] + report["skipped"] + report["invalid"]:
        raise ValueError("the counters don't add up to the rows processed")
    return report


class Store:
    """Tables of one folder. Readers see the version that the manifest names; old versions stay for those who read them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._token: str | None = None
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def manifest(self) -> dict:
        path = self._path("manifest.json")
        if not self._fs.exists(path):
            return {"version": 0, "tables": {}, "state": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first()[0])

    def read(self, table: str) -> DataFrame | None:
        folders = self.manifest()["tables"].get(table)
        if folders is None:
            return None
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.folder}/{x}" for x in folders))

    def commit(self, tables: dict[str, DataFrame], state: dict | None = None, more: dict[str, DataFrame] | None = None) -> int:
        """Write the tables, and rows to be added to those of `more`, then make all current together; tables not named
        stay as they were. Columns that only later rows of a table have are null in earlier ones."""
        now = self.manifest()
        version = now["version"] + 1
        for added, named in ((False, tables), (True, more or {})):
            for name, df in named.items():
                folder = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
                df.write.parquet(f"{self.folder}/{folder}")
                now["tables"][name] = [*(now["tables"].get(name, []) if added else []), folder]
        now["version"] = version
        now["state"] |= state or {}
        self._swap(json.dumps(now))
        return version

    # -- tables in buckets: a batch of changes writes the buckets of its keys, the others stay as they are

    def commit_buckets(self, table: str, rows: DataFrame, key: list[str], n: int = BUCKETS) -> int:
        """Write a table dealt into n buckets by its key; later changes go through `upsert_buckets`."""
        now = self.manifest()
        now["tables"].pop(table, None)
        now.setdefault("buckets", {})[table] = {"key": key, "n": n, "folders": {}, "schema": rows.schema.json()}
        return self._bucketed(now, table, rows)

    def _bucketed(self, now: dict, table: str, rows: DataFrame) -> int:
        """Write rows to new folders of their buckets, and make these current."""
        about, folder = now["buckets"][table], f"{table}/v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn(BUCKET, bucket_of(about["key"], about["n"])).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.folder}/{folder}")
        there = self._fs.listStatus(self._path(folder))
        about["folders"] |= {name.split("=")[1]: f"{folder}/{name}" for name in (f.getPath().getName() for f in there) if name.startswith(f"{BUCKET}=")}
        now["version"] += 1
        self._swap(json.dumps(now))
        return now["version"]

    def read_buckets(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A bucketed table, or those buckets of it."""
        about = self.manifest().get("buckets", {}).get(table)
        if about is None:
            return None
        schema = T.StructType.fromJson(json.loads(about["schema"]))
        folders = [x for b, x in about["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    def upsert_buckets(self, table: str, incoming: DataFrame, kept: tuple[str, ...] = (), removed: DataFrame | None = None) -> list[int]:
        """Put incoming rows, one a key, in the place of stored ones of their key, and take the keys of `removed` out;
        returns the buckets that were written. A bucket that is left without rows is kept as no folder."""
        from tessera.operators.changes import upsert

        now = self.manifest()
        about = now["buckets"][table]
        key = about["key"]
        incoming = written(incoming, "incoming")
        keys = incoming.select(*key) if removed is None else incoming.select(*key).unionByName(removed.select(*key))
        touched = sorted(r[0] for r in keys.select(bucket_of(key, about["n"])).distinct().collect())  # n at most
        if not touched:
            return []
        after = upsert(self.read_buckets(table, touched), incoming, key, kept)
        if removed is not None:
            after = after.join(removed.select(*key), key, "left_anti").select(*after.columns)
        for b in touched:
            about["folders"].pop(str(b), None)
        self._bucketed(now, table, after)
        return touched

    def _swap(self, text: str) -> None:
        if self._token is not None and self._holder() != self._token:
            raise Busy("another run has taken the store over")
        made = self._path(f"manifest.{uuid.uuid4().hex}.tmp")
        self._write(made, text, True)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(made), context.makeQualified(self._path("manifest.json")), options)

    def _write(self, path, text: str, over: bool) -> None:
        out = self._fs.create(path, over)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _holder(self) -> str | None:
        """Who holds the store."""
        path = self._path("run.lock")
        return self.spark.read.text(path.toString(), wholetext=True).first()[0] if self._fs.exists(path) else None

    @contextmanager
    def lock(self, stale: float = 6 * 3600):
        """Hold the store for one run; raises Busy if it is held. A lock that is older than `stale` seconds is taken over:
        moved away first, which only one of several can do. A run whose lock was taken over can't commit any more, and
        leaves the lock of the other alone."""
        path, token = self._path("run.lock"), uuid.uuid4().hex
        if self._fs.exists(path) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > stale:
            aside = self._path(f"run.lock.{token}")
            if self._fs.rename(path, aside):
                self._fs.delete(aside, False)
        try:
            self._write(path, token, False)
        except Exception as e:
            if self._fs.exists(path):
                raise Busy("another run holds the store") from e
            raise
        self._token = token
        try:
            yield self
        finally:
            self._token = None
            if self._holder() == token:
                self._fs.delete(path, False)
