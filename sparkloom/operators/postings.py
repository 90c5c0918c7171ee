"""A stored inverted index for BM25 with bounds for blocks of documents.

A load of documents is a segment. It deals its documents out to ranges of about RANGE_DOCS by a hash of the id, and holds one row for each
term and range: the ids, term frequencies and lengths, and ahead of them how many documents there are, and those pairs of frequency and length that
no other document's pair beats in both, from which the block's greatest score follows for any mean length of the corpus.
Rows lie in directories by a hash of the term, sorted by term, so a search opens its terms' directories only and reads the
heads of their rows first. Segments are never changed: deleting or replacing documents writes the (segment, term, range, id) that
are no longer alive, and a new manifest. A merge writes the living postings as one segment.

A search for the k best, exactly as if all postings had been scored:

1. From the heads: document frequencies and, for every query and range, the sum of its terms' bounds; no document of the range
   can score more.
2. The ranges with the highest bounds that hold k candidates are scored. The k-th score is the query's floor.
3. Only ranges whose bound reaches the floor are scored besides.

Only the heads' sums by (query, range) are shuffled, and postings of the ranges that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.retrieval import K1, B, tokens, top_k
from sparkloom.sources.folders import written
from sparkloom.sources.tables import spread
from sparkloom.sources.versions import VersionedFolder

BUCKETS, RANGE_DOCS = 64, 1024
#: Distinct terms of one call's queries that go to all tasks; more are met by a join.
MAX_TERMS = 100_000
#: Words of a batch of documents that are counted at once; a longer document is counted by itself.
HELD_WORDS = 500_000
HEAD = ["bucket", "term", "range", "n", "impacts"]


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _range(doc: str | Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(doc, F.lit(17)), F.lit(ranges)).cast("int")


def _grouped(own: DataFrame) -> DataFrame:
    """Rows of whole blocks from parts of blocks (term, range, docs)."""
    docs = F.flatten(F.collect_list("docs"))
    blocks = own.groupBy("term", "range").agg(F.sort_array(docs).alias("docs"))
    by_tf = F.array_sort(F.transform("docs", lambda d: F.struct((-d["tf"]).alias("less"), d["length"].alias("length"))))
    none = F.array().cast("array<struct<tf:int,length:int>>")
    add = lambda best, d: F.concat(best, F.array(F.struct((-d["less"]).alias("tf"), d["length"].alias("length"))))
    beaten = lambda best, d: F.coalesce(F.try_element_at(best, F.lit(-1))["length"] <= d["length"], F.lit(False))
    impacts = F.aggregate(by_tf, none, lambda best, d: F.when(beaten(best, d), best).otherwise(add(best, d)))
    return blocks.select(_bucket("term").alias("bucket"), "term", "range", F.size("docs").alias("n"), impacts.alias("impacts"), "docs")


def _parts(words: DataFrame) -> DataFrame:
    """Parts of blocks from (doc, length, range, words). A task's own documents of a term and range are one row, for each HELD_WORDS words of a batch of
    documents; words are counted as numbers of the batch's own dictionary, so memory doesn't grow with the batch."""
    doc = words.schema["doc"].dataType
    arrays = T.ArrayType(T.StructType([T.StructField("doc", doc), T.StructField("tf", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("docs", arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("words").offsets.to_numpy().astype(np.int64)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + HELD_WORDS, "right")) - 1)
                own = batch.slice(first, last - first)
                n, sizes = own.num_rows, np.diff(ends[first : last + 1])
                first = last
                coded = own.column("words").flatten().dictionary_encode()
                row = np.repeat(np.arange(n), sizes)
                pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + row, return_counts=True)
                code, row = pairs // n, pairs % n
                place = own.column("range").to_numpy()[row]
                order = np.lexsort((row, place, code))
                code, row, place, tf = code[order], row[order], place[order], tf[order]
                new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
                at = pa.array(row)
                found = pa.StructArray.from_arrays([own.column("doc").take(at), pa.array(tf, pa.int32()), own.column("length").take(at)], ["doc", "tf", "length"])
                docs = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), found)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[new])), pa.array(place[new], pa.int32()), docs], schema.names)

    return words.select("doc", "length", "range", "words").mapInArrow(run, schema)


class InvertedIndex:
    """An index in a folder. Ids are unique in a load; to load an id again replaces its document."""

    def __init__(self, spark: SparkSession, path: str, range_docs: int = RANGE_DOCS):
        self.spark, self.folder, self.range_docs = spark, VersionedFolder(spark, path), range_docs

    def _manifest(self, version: int | None = None) -> dict:
        return {"segments": [], "dead": [], "docs": 0, "words": 0, "id": "bigint"} | self.folder.manifest(version)

    def _read(self, manifest: dict, folder: str, kind: str) -> DataFrame:
        columns = {
            "blocks": "term string, range int, n int, impacts array<struct<tf:int,length:int>>, docs array<struct<doc:{0},tf:int,length:int>>, bucket int",
            "docs": "doc {0}, length int, terms array<string>", "dead": "segment int, doc {0}, range int, term string, bucket int", "gone": "segment int, doc {0}",
        }
        return self.spark.read.schema(columns[kind].format(manifest["id"])).parquet(folder)

    def _write_blocks(self, blocks: DataFrame) -> str:
        """Files are dealt out by ranges of the sort order, so a common term's blocks lie in several."""
        rows = blocks.repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range")
        return self.folder.written(rows, "bucket")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Loads documents; those with a null id are left out, a null text has no words."""
        old = self._manifest()
        words = spread(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("words"))
        own = written(words.withColumn("length", F.size("words")))
        size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        if not size.n:
            return old
        ranges = -(-size.n // self.range_docs)
        own = own.withColumn("range", _range("doc", ranges))
        segment = {"id": old["version"] + 1, "ranges": ranges, "blocks": self._write_blocks(_grouped(_parts(own)))}
        segment["docs"] = self.folder.written(own.select("doc", "length", F.array_distinct("words").alias("terms")).sort("doc"))
        dead, lost = self._killed(old, own.select("doc"))
        new = {"segments": [*old["segments"], segment], "dead": [*old["dead"], *dead], "docs": old["docs"] + size.n - lost[0], "words": old["words"] + size.words - lost[1], "id": own.schema["doc"].dataType.simpleString()}
        return self.folder.commit(old["version"], new)

    def delete(self, ids: DataFrame) -> dict:
        """Removes the documents with the ids in the only column of ids; unknown ones do nothing."""
        old = self._manifest()
        dead, lost = self._killed(old, ids.toDF("doc").where("doc IS NOT NULL").distinct())
        if not dead:
            return old
        return self.folder.commit(old["version"], old | {"dead": [*old["dead"], *dead], "docs": old["docs"] - lost[0], "words": old["words"] - lost[1]})

    def _living(self, manifest: dict) -> DataFrame | None:
        """(segment, doc, length, terms) of the documents that count."""
        parts = [self._read(manifest, s["docs"], "docs").withColumns({"segment": F.lit(s["id"]), "ranges": F.lit(s["ranges"])}) for s in manifest["segments"]]
        if not parts:
            return None
        docs = reduce(DataFrame.unionByName, parts)
        gone = self._dead(manifest, "gone")
        return docs if gone is None else docs.join(gone.select("segment", "doc"), ["segment", "doc"], "left_anti")

    def _dead(self, manifest: dict, kind: str) -> DataFrame | None:
        parts = [self._read(manifest, d[kind], kind) for d in manifest["dead"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _killed(self, manifest: dict, ids: DataFrame) -> tuple[list[dict], tuple[int, int]]:
        """Writes the postings and documents that ids end, and counts the latter and their words."""
        living = self._living(manifest)
        if living is None:
            return [], (0, 0)
        hit = written(living.join(ids, "doc", "left_semi"))
        lost = hit.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        if not lost.n:
            return [], (0, 0)
        ranges = F.pmod(F.xxhash64("doc", F.lit(17)), F.col("ranges")).cast("int")
        gone = hit.select("segment", "doc", ranges.alias("range"), F.explode("terms").alias("term")).withColumn("bucket", _bucket("term"))
        postings = self.folder.written(gone.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), "bucket")
        return [{"dead": postings, "gone": self.folder.written(hit.select("segment", "doc"))}], (lost.n, lost.words)

    def _blocks(self, manifest: dict, columns: list[str]) -> DataFrame:
        parts = [self._read(manifest, s["blocks"], "blocks").select(*columns, F.lit(s["id"]).alias("segment")) for s in manifest["segments"]]
        return reduce(DataFrame.unionByName, parts)

    def merge(self) -> dict:
        """All living postings as one segment."""
        old = self._manifest()
        if len(old["segments"]) < 2 and not old["dead"]:
            return old
        ranges = max(1, -(-old["docs"] // self.range_docs))
        each = self._blocks(old, ["term", "docs"]).select("segment", "term", F.inline("docs"))
        dead = self._dead(old, "gone")
        each = each if dead is None else each.join(dead.select("segment", "doc"), ["segment", "doc"], "left_anti")
        parts = each.select("term", _range("doc", ranges).alias("range"), F.array(F.struct("doc", "tf", "length")).alias("docs"))
        segment = {"id": old["version"] + 1, "ranges": ranges, "blocks": self._write_blocks(_grouped(parts))}
        segment["docs"] = self.folder.written(self._living(old).select("doc", "length", "terms").sort("doc"))
        return self.folder.commit(old["version"], {"segments": [segment], "dead": [], "docs": old["docs"], "words": old["words"], "id": old["id"]})

    def search(self, queries: DataFrame, k: int, version: int | None = None) -> DataFrame:
        """(query, doc, score, rank) of the k best documents of each query (query, text)."""
        return self._search(queries, k, version)[0]

    def _search(self, queries: DataFrame, k: int, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The result, and (query, blocks, blocks_read)."""
        manifest = self._manifest(version)
        asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
        if not manifest["segments"]:
            none = asked.where("false").select("query", F.lit(None).cast("long").alias("doc"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
            return none, asked.where("false").select("query", F.lit(0).alias("blocks"), F.lit(0).alias("blocks_read"))
        asked = written(asked)
        terms = asked.select("term", _bucket("term").alias("bucket")).distinct()
        small = terms.count() <= MAX_TERMS
        sent = F.broadcast(terms) if small else terms
        open_ = F.col("bucket").isin([r["bucket"] for r in terms.select("bucket").distinct().collect()])  # BUCKETS at most
        heads = written(self._blocks(manifest, HEAD).where(open_).join(sent, ["bucket", "term"], "left_semi"))
        dead = self._dead(manifest, "dead")
        dead = None if dead is None else written(dead.where(open_).join(sent, ["bucket", "term"], "left_semi"))
        alive = heads.select("term", "n")
        if dead is not None:
            alive = alive.unionByName(dead.select("term", F.lit(-1).alias("n")))
        df = alive.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        n, mean = float(manifest["docs"]), (manifest["words"] / manifest["docs"] if manifest["docs"] else 0.0) or 1.0
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        weights = written(asked.join(df, "term").select("query", "term", (F.col("times") * idf).alias("weight")))
        worth = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        both = heads.join(F.broadcast(weights) if small else weights, "term")
        bound = F.sum(F.col("weight") * F.array_max(F.transform("impacts", lambda i: worth(i["tf"].cast("double"), i["length"]))))
        ranges = written(both.groupBy("query", "segment", "range").agg(bound.alias("bound"), F.max("n").alias("n"), F.count(F.lit(1)).alias("blocks")))

        def scored(some: DataFrame) -> DataFrame:
            """(query, doc, score) of all documents in some (query, segment, range)."""
            keys = some.join(weights, "query").select("query", "segment", "range", "term", _bucket("term").alias("bucket"), "weight")
            rows = self._blocks(manifest, ["bucket", "term", "range", "docs"]).where(open_).join(sent, ["bucket", "term"], "left_semi")
            each = rows.join(keys, ["bucket", "term", "range", "segment"]).select("query", "term", "segment", "weight", F.inline("docs"))
            if dead is not None:
                each = each.join(dead.select("term", "segment", "doc"), ["term", "segment", "doc"], "left_anti")
            score = F.sum(F.col("weight") * worth(F.col("tf").cast("double"), F.col("length")))
            return each.groupBy("query", "doc").agg(F.round(score, 6).alias("score"))

        # A range has at least as many documents as its largest block; two ranges more for those that are deleted or score little.
        ahead = W.partitionBy("query").orderBy(F.desc("bound"), "segment", "range")
        before = F.coalesce(F.sum("n").over(ahead.rowsBetween(W.unboundedPreceding, -3)), F.lit(0))
        best = written(ranges.withColumn("before", before).where(F.col("before") < k).select("query", "segment", "range", "blocks"))
        first = written(top_k(scored(best), k, "query", "score", "doc"))
        floor = first.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor")).where(F.col("found") >= k)
        rest = ranges.join(best.select("query", "segment", "range"), ["query", "segment", "range"], "left_anti").join(floor, "query", "left")
        rest = rest.where("floor IS NULL OR bound >= floor - 1e-6").select("query", "segment", "range", "blocks")
        result = top_k(first.drop("rank").unionByName(scored(rest)), k, "query", "score", "doc")
        read = best.unionByName(rest).groupBy("query").agg(F.sum("blocks").alias("blocks_read"))
        return result, ranges.groupBy("query").agg(F.sum("blocks").alias("blocks")).join(read, "query")
