"""A keyed table in versioned files: insert or replace, delete, compare-and-set, expiry, and a sink for streams.

Rows lie in buckets by a hash of the key. A change table is joined with the buckets it touches only; those are written anew beside the old
ones, all other buckets stay, and one commit of a manifest makes the version. Readers hold a version, so a writer never
changes what they read, and old versions can be read until they are vacuumed. Of two writers that start from one version the
second fails with VersionConflict and has written nothing that counts.

A row has, besides its key and columns, row_version (1 for a new key, one more with each change), written_at and expires_at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.merge import latest
from sparkloom.sources.folders import written
from sparkloom.sources.versions import VersionConflict, VersionedFolder

META = ("row_version", "written_at", "expires_at")


class KeyedTable:
    """schema: the key column first. buckets is fixed when the table is made: a bucket is what the smallest change rewrites, so about a
    file's worth of rows each, and it is kept in the manifest."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, buckets: int = 64):
        self.spark, self.folder = spark, VersionedFolder(spark, path)
        now = self.folder.manifest()
        if now["version"] == 0:
            if schema is None:
                raise ValueError(f"{path}: no table there, and no schema to make one")
            now = self.folder.commit(0, {"schema": schema.json(), "buckets": buckets, "files": {}, "applied": {}})
        self.schema = T.StructType.fromJson(json.loads(now["schema"]))
        self.key, self.buckets = self.schema.names[0], now["buckets"]
        taken = set(self.schema.names) & set(META)
        if taken:
            raise ValueError(f"columns that the table itself has: {sorted(taken)}")
        self.stored = T.StructType([*self.schema.fields, T.StructField("row_version", T.LongType()), T.StructField("written_at", T.TimestampType()), T.StructField("expires_at", T.TimestampType())])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, read from their folders alone."""
        files = manifest["files"]
        wanted = sorted({f for b, fs in files.items() if buckets is None or int(b) in buckets for f in fs})
        if not wanted:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*wanted)

    def read(self, version: int | None = None, at: datetime | None = None) -> DataFrame:
        """All rows of a version (the newest by default). at: without those that have expired by then."""
        rows = self._rows(self.folder.manifest(version))
        return rows if at is None else rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(at)))

    def get(self, keys: list, version: int | None = None, most: int = 1000) -> DataFrame:
        """Rows of the keys, from their buckets only. More than most keys in one call are refused; join read() with a table of keys then."""
        if len(keys) > most:
            raise ValueError(f"{len(keys)} keys in one lookup, {most} at most")
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        buckets = [r[0] for r in asked.select(self._bucket(F.col(self.key))).distinct().collect()]
        return self._rows(self.folder.manifest(version), buckets).where(F.col(self.key).isin(keys))

    def read_for(self, keys: DataFrame) -> DataFrame:
        """Rows of the buckets that keys (with the key's column) fall in: all rows of these keys, and others. No other bucket is read."""
        buckets = [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket(F.col(self.key))).distinct().collect()]
        return self._rows(self.folder.manifest(), buckets)

    def apply(self, changes: DataFrame, at: datetime, parent: int | None = None, writer: tuple[str, int] | None = None) -> tuple[DataFrame, dict]:
        """Applies changes (key, columns, and optionally op, seq, expected, ttl_seconds) and returns what became of each key and the manifest.

        op is upsert (default) or delete; of a key's changes the one with the greatest seq counts. expected (long) demands that row version, 0
        that there be no row; a change without it is unconditional. at is the time of writing; a row lives ttl_seconds from then, or for ever.
        parent: the version that the changes were made on; VersionConflict if the table has gone on. writer: a name and number; a
        number not above the name's last one was applied before and is skipped, so a batch may be sent again.

        Result rows (key, outcome, row_version): inserted, updated, deleted, absent (nothing to delete) or conflict. A null key is a conflict.
        """
        manifest = self.folder.manifest()
        if parent is not None and parent != manifest["version"]:
            raise VersionConflict(f"the table is at version {manifest['version']}, not {parent}")
        outcome = T.StructType([self.schema[self.key], T.StructField("outcome", T.StringType()), T.StructField("row_version", T.LongType())])
        if writer and manifest["applied"].get(writer[0], -1) >= writer[1]:
            return self.spark.createDataFrame([], outcome), manifest
        rest = [c for c in self.schema.names if c != self.key]
        default = {"op": F.lit("upsert"), "seq": F.lit(0), "expected": F.lit(None).cast("long"), "ttl_seconds": F.lit(None).cast("double")}
        given = {n: F.col(n) if n in changes.columns else d for n, d in default.items()}
        all_ = changes.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], *[v.alias(f"__{n}") for n, v in given.items()])
        last = latest(all_, [self.key], ["__seq"]).withColumn("__bucket", self._bucket(F.col(self.key)))
        last = written(last)
        touched = sorted(r[0] for r in last.where(F.col(self.key).isNotNull()).select("__bucket").distinct().collect())
        old = self._rows(manifest, touched).select(*[F.col(c).alias(f"__old_{c}") for c in self.stored.names])
        both = old.join(last, F.col(f"__old_{self.key}") == F.col(self.key), "full")
        there, change = F.col("__old_row_version").isNotNull(), F.col("__op").isNotNull()
        version = F.coalesce(F.col("__old_row_version"), F.lit(0))
        wrong = F.col(self.key).isNull() | (F.col("__expected").isNotNull() & (F.col("__expected") != version))
        result = F.when(~change, None).when(wrong, "conflict").when(F.col("__op") == "delete", F.when(there, "deleted").otherwise("absent")).when(there, "updated").otherwise("inserted")
        decided = written(both.withColumn("__result", result))
        new = F.col("__result").isin("inserted", "updated")
        expires = F.timestamp_micros(F.unix_micros(F.lit(at)) + (F.col("__ttl_seconds") * 1e6).cast("long"))
        meta = [(version + 1).cast("long"), F.lit(at), expires]
        pick = lambda c, value: F.when(new, value).otherwise(F.col(f"__old_{c}")).alias(c)
        kept = decided.where(new | (there & F.coalesce(F.col("__result") != "deleted", F.lit(True))))
        rows = kept.select(*[pick(c, F.col(c)) for c in self.schema.names], *[pick(c, v) for c, v in zip(META, meta)])
        files = dict(manifest["files"])
        changed = sorted(r[0] for r in decided.where(F.col("__result").isin("inserted", "updated", "deleted")).select("__bucket").distinct().collect())
        if changed:
            out = rows.withColumn("__b", self._bucket(F.col(self.key))).where(F.col("__b").isin(changed))
            folder = self.folder.written(out.repartition("__b"), "__b")
            have = {s.getPath().getName() for s in self.folder._fs.listStatus(self.folder._hadoop.Path(folder))}
            for b in changed:
                name = f"__b={b}"
                files[str(b)] = [f"{folder}/{name}"] if name in have else []
        applied = manifest["applied"] | ({writer[0]: writer[1]} if writer else {})
        content = {"schema": manifest["schema"], "buckets": self.buckets, "files": files, "applied": applied}
        done = self.folder.commit(manifest["version"], content) if changed or writer else manifest
        after = F.when(new, version + 1).when(F.col("__result") == "conflict", version).otherwise(F.lit(None))
        key = F.coalesce(F.col(self.key), F.col(f"__old_{self.key}"))
        return decided.where(change).select(key.alias(self.key), F.col("__result").alias("outcome"), after.cast("long").alias("row_version")), done

    def sink(self, name: str, at: Callable[[], datetime], changes: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: applies each batch once, whatever is sent again after a restart."""
        return lambda batch, number: self.apply(changes(batch), at(), writer=(name, number)) and None

    def vacuum(self, keep: int = 1) -> int:
        """Removes what only older versions need."""
        return self.folder.vacuum(lambda m: {f.rsplit("/", 1)[0] for fs in m.get("files", {}).values() for f in fs}, keep)
