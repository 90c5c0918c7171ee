"""A folder with versions: immutable data folders, and a manifest for each version that names those it consists of."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class VersionConflict(Exception):
    """Someone else has committed the version."""


class VersionedFolder:
    """Data folders under path/data, manifests under path/versions. A commit is a rename that fails if its target exists, so of two writers
    with the same parent one wins; data that no manifest names is not part of any version. The file system must be one that all
    executors see and must rename atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Content of a version, the newest by default; {"version": 0} if there is none."""
        known = self.versions()
        if not known and version in (None, 0):
            return {"version": 0}
        stream = self._fs.open(self._hadoop.Path(self._name(known[-1] if version is None else version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, parent: int, content: dict) -> dict:
        """Makes content version parent + 1; VersionConflict if that is there."""
        new = content | {"version": parent + 1}
        part = self._hadoop.Path(f"{self.path}/versions/{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(part, self._hadoop.Path(self._name(parent + 1)), options)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionConflict(f"{self.path}: version {parent + 1} is taken") from e
            raise
        return new

    def new_data(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def written(self, df: DataFrame, *partitions: str) -> str:
        """Writes df to a new data folder, one directory for each value of partitions."""
        folder = self.new_data()
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(folder)
        return folder

    def vacuum(self, named_by, keep: int = 1) -> int:
        """Removes data folders that none of the last keep versions names; named_by(manifest) lists a manifest's. Older manifests go too.
        Not to be run beside a writer, whose folders have no manifest yet."""
        known = self.versions()
        live = {f for v in known[-keep:] for f in named_by(self.manifest(v))}
        gone = 0
        data = self._hadoop.Path(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"{self.path}/data/{s.getPath().getName()}" not in live:
                gone += self._fs.delete(s.getPath(), True)
        for v in known[:-keep]:
            self._fs.delete(self._hadoop.Path(self._name(v)), False)
        return gone
