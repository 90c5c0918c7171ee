"""Incremental load of documents into a store of chunks with vectors."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.embedding import hash_embed
from sparkloom.operators.chunking import sentence_chunks
from sparkloom.operators.store import KeyedTable
from sparkloom.sources.folders import written

#: Longer documents are refused, as the store takes none of that size.
MAX_CHARS = 1_000_000


class ChunkStore:
    """Chunks in a folder for each load, and a ledger with a row for each document: hash of its text, its last load, status and number of chunks. The
    ledger is a KeyedTable, so a load reads and rewrites the buckets of its own documents only; it is committed last, and chunks of a
    load that it doesn't name count for nothing."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        columns = [T.StructField("doc_id", id_type), *(T.StructField(n, T.StringType()) for n in ("hash", "load", "status")), T.StructField("chunks", T.LongType())]
        self.ledger = KeyedTable(spark, f"{self.path}/ledger", T.StructType(columns), buckets)
        kind = self.ledger.schema["doc_id"].dataType.simpleString()
        self._chunks = f"doc_id {kind}, chunk bigint, first_sentence bigint, n_sentences bigint, content string, chunk_id string, embedding array<double>, load string"

    def load(self, docs: DataFrame, at: datetime, most: int = 1500, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
        """(doc_id, status, chunks) of each document: loaded, unchanged (its text has the hash of the last load, so nothing is embedded again), empty or
        failed (too long). An empty or failed one has no chunks any more. Of rows with one id the last by order counts (by default
        by length, then text); rows without an id are left out and have the status empty with a null id."""
        own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([] if order is None else [F.struct(order).alias("o")]))
        # One copy of a text is kept and shuffled; the join with the ledger follows by the same key.
        last = F.max(F.struct(F.length("text").alias("n"), "text"))["text"] if order is None else F.max_by("text", "o")
        one = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(last, F.lit("")).alias("text")).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
        old = self.ledger.read_for(own).select("doc_id", F.col("hash").alias("old"), F.col("chunks").alias("had"), F.col("status").alias("was"))
        both = one.join(old, "doc_id", "left")
        same = F.col("old").eqNullSafe(F.col("hash")) & F.col("was").isin("loaded", "empty") & (F.length("text") <= max_chars)
        judged = written(both.withColumn("same", F.coalesce(same, F.lit(False))))
        name = uuid.uuid4().hex
        new = judged.where(~F.col("same") & (F.length("text") <= max_chars))
        chunks = sentence_chunks(new.select("doc_id", "text"), most, 1, "doc_id", "text")
        chunks = chunks.withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk").cast("string")))
        hash_embed(chunks, text_col="content").write.parquet(f"{self.path}/chunks/load={name}")
        made = self.spark.read.schema(self._chunks).option("basePath", f"{self.path}/chunks").parquet(f"{self.path}/chunks/load={name}")
        counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        status = F.when(F.length("text") > max_chars, "failed").when(F.col("n").isNull(), "empty").otherwise("loaded")
        changed = judged.where(~F.col("same")).join(counts, "doc_id", "left").select("doc_id", "hash", F.lit(name).alias("load"), status.alias("status"), F.coalesce("n", F.lit(0)).alias("chunks"))
        changed = written(changed)
        self.ledger.apply(changed, at)
        kept = judged.where("same").select("doc_id", F.lit("unchanged").alias("status"), F.col("had").alias("chunks"))
        lost = own.where("doc_id IS NULL").select("doc_id", F.lit("empty").alias("status"), F.lit(0).cast("long").alias("chunks"))
        return changed.select("doc_id", "status", "chunks").unionByName(kept).unionByName(lost)

    def delete(self, ids: DataFrame, at: datetime) -> DataFrame:
        """(doc_id, outcome): the documents of the only column of ids go, with their chunks."""
        gone = ids.toDF("doc_id").where("doc_id IS NOT NULL").distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.ledger.schema.fields[1:]]
        return self.ledger.apply(gone.select("doc_id", *empty, F.lit("delete").alias("op")), at)[0].select("doc_id", "outcome")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks that count, of a version of the ledger. Only the folders of loads that it names are read."""
        ledger = self.ledger.read(version).where("chunks > 0").select("doc_id", "load")
        loads = [r[0] for r in ledger.select("load").distinct().collect()]  # one name for each load, not document
        if not loads:
            return self.spark.createDataFrame([], self._chunks)
        rows = self.spark.read.schema(self._chunks).option("basePath", f"{self.path}/chunks").parquet(*[f"{self.path}/chunks/load={n}" for n in loads])
        return rows.join(ledger, ["doc_id", "load"], "left_semi")
