"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. A tier holds shards of similar size (a power of fanout apart); a tier with
fanout shards or more is merged into runs of the target size at most, these count in their own tier, and so on until no tier is
full. The cascade is worked out on the sizes in the manifest, then each shard that it touches is read and written once, a job for
each tier of the outcome; Spark packs the shards of a job into files of the outcome's size at most. No row is shuffled.

A version is committed by renaming its finished manifest to the version's name, which fails if that exists (the file system's
rename must be atomic, as in HDFS). A writer that dies before has committed nothing and blocks nobody. Readers see the newest
manifest or any older one whose shards aren't vacuumed; shards that failed or lost writers left behind are in none, and
vacuum deletes them once they are old.

Defined cases: rows are kept as they are, nulls and repeated rows too; an empty table commits a version without
shards; a lost race raises ConflictError and leaves the other's version; shards keep the schema that they were written with,
and columns that a newer arrival adds are null in older shards; a column of another type is an error of the append.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm._common import TMP, shared_dir

#: About 100 bytes each.
MAX_BROADCAST_SHARDS = 100_000


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


@contextmanager
def _packed(spark: SparkSession, size: int):
    """Files are read in partitions of size bytes at most, and as few as that takes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


class ShardStore:
    """Folder of shards and manifests on a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest_bytes: int = 64 << 10):
        self.spark, self.path, self.target, self.fanout, self.smallest = spark, path, target_bytes, fanout, smallest_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:08d}.json"

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            return {"version": 0, "shards": [], "schema": StructType([]).json()}
        stream = self._fs.open(self._at(self._name(version or versions[-1])))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, parent: int, shards: list[dict], schema: str) -> dict:
        """Version parent + 1, unless someone else has it."""
        new = {"version": parent + 1, "parent": parent, "schema": schema, "shards": shards}
        part = self._at(f"{self.path}/manifests/{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(part, self._at(self._name(parent + 1)), options)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConflictError(f"version {parent + 1}") from e
            raise
        return new

    def _written(self, df: DataFrame, per_file: int | None = None) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (df.write.option("maxRecordsPerFile", per_file) if per_file else df.write).parquet(folder)
        files = [s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-")]
        return [{"file": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen(), "tier": self.tier(s.getLen())} for s in files]

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)))

    def append(self, df: DataFrame, rows_per_shard: int = 2000) -> dict:
        now = self.manifest()
        fields = {f.name: f for f in StructType.fromJson(json.loads(now["schema"]))}
        for f in df.schema:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} has another type in the store")
            fields.setdefault(f.name, f)
        return self.commit(now["version"], now["shards"] + self._written(df, rows_per_shard), StructType([*fields.values()]).json())

    def vacuum(self, keep_versions: int = 1, orphan_seconds: float = 86_400.0) -> int:
        """Delete the shards that no manifest of the newest keep_versions names: those of older versions, which can't be read
        any more, and those of writers that committed nothing for orphan_seconds. Returns how many."""
        versions = self.versions()
        kept = {s["file"] for v in versions[-keep_versions:] for s in self.manifest(v)["shards"]}
        gone = {s["file"] for v in versions[:-keep_versions] for s in self.manifest(v)["shards"]} - kept
        known, now = kept | gone, time.time()
        data = self._at(f"{self.path}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if now - folder.getModificationTime() / 1000 >= orphan_seconds:
                inside = [f"{self.path}/data/{folder.getPath().getName()}/{s.getPath().getName()}" for s in self._fs.listStatus(folder.getPath())]
                gone |= {f for f in inside if "/part-" in f and f not in known}
        return sum(bool(self._fs.delete(self._at(f), False)) for f in gone)

    def plan(self, shards: list[dict]) -> list[tuple[int, list[dict]]]:
        """(size of a file, shards to be merged) of each merge that leaves no tier below half the target with fanout shards."""
        runs = [(s["bytes"], [s]) for s in shards if s["bytes"] < self.target // 2]
        while True:
            tiers: dict[int, list[tuple[int, list[dict]]]] = {}
            for r in runs:
                if r[0] < self.target // 2:
                    tiers.setdefault(self.tier(r[0]), []).append(r)
            full = [t for t, own in tiers.items() if len(own) >= self.fanout]
            if not full:
                break
            own = tiers[min(full)]
            taken = set(map(id, own))
            runs = [r for r in runs if id(r) not in taken]
            size, merged = 0, []
            for r in own:
                if merged and size + r[0] > self.target:
                    runs.append((size, merged))
                    size, merged = 0, []
                size, merged = size + r[0], merged + r[1]
            runs.append((size, merged))
        jobs: dict[int, tuple[int, list[dict]]] = {}
        for size, merged in runs:
            if len(merged) > 1:
                most, own = jobs.get(self.tier(size), (0, []))
                jobs[self.tier(size)] = max(most, size), own + merged
        return [jobs[t] for t in sorted(jobs)]

    def compact(self) -> dict:
        """Commit a version of which no tier below half the target has fanout shards, as far as the sizes in the manifest tell."""
        now = self.manifest()
        shards, jobs = now["shards"], self.plan(now["shards"])
        if not jobs:
            return now
        for size, own in jobs:
            with _packed(self.spark, size):
                merged = self._written(self._read([s["file"] for s in own], now["schema"]))
            gone = {s["file"] for s in own}
            shards = [s for s in shards if s["file"] not in gone] + merged
        return self.commit(now["version"], shards, now["schema"])

    def _read(self, files: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*files)

    def read(self, version: int | None = None, shard_col: str = "shard", tier_col: str = "tier") -> DataFrame:
        """The rows of a version, with the number of their shard in its manifest and the shard's tier. Columns of the rows that have one of these names
        are left out; under other names both are there."""
        now = self.manifest(version)
        if not now["shards"]:
            raise ValueError("no shards")
        df = self._read([s["file"] for s in now["shards"]], now["schema"])
        df = df.drop(shard_col, tier_col).withColumn(f"{TMP}file", F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1))
        known = [("/".join(s["file"].rsplit("/", 2)[1:]), i, s["tier"]) for i, s in enumerate(now["shards"])]
        shards = self.spark.createDataFrame(known, f"{TMP}file string, `{shard_col}` int, `{tier_col}` int")
        return df.join(F.broadcast(shards) if len(known) <= MAX_BROADCAST_SHARDS else shards, f"{TMP}file").drop(f"{TMP}file")


def op8(docs: DataFrame) -> DataFrame:
    """Where each document is after arrivals were appended and compacted."""
    store = ShardStore(docs.sparkSession, shared_dir(docs.sparkSession))
    store.append(docs)
    if not store.manifest()["shards"]:
        return docs.select("doc_id", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("tier"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    store.compact()
    return store.read().select("doc_id", "shard", "tier", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
