"""A stored vector index of cells (an inverted file): k-means centres, and the vectors in directories by their nearest centre.

The centres are fitted by MLlib on a bounded random sample (SAMPLE vectors at most); every vector is in the index. A search opens the cells
nearest to its queries only, as partition pruning, and scores all of their vectors exactly. How many cells a query opens is set when
the index is made: as few as find `recall` of the true nearest of PROBE_QUERIES of the index's own vectors, measured against all
vectors. The manifest holds each cell's size, so a query whose cells hold fewer than k vectors opens the next ones too, and always gets k.

Vectors and queries are compared by cosine. Vectors of another length than the first one's, null ones and zero vectors are in a cell of their own, which
every search opens: they score 0, as in nearest_k.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.retrieval import Kept, _units, in_blocks, nearest_k, top_k
from sparkloom.sources.folders import written
from sparkloom.sources.tables import spread
from sparkloom.sources.versions import VersionedFolder

SAMPLE, PROBE_QUERIES = 200_000, 64
#: Cell of vectors without a direction.
NOWHERE = -1


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, VersionedFolder(spark, path)

    def build(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.95, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> dict:
        """A version of the index of all vectors; other columns are kept with them. cells: about the root of their number by default, 4096 at most."""
        parent = self.folder.manifest()["version"]
        size = vectors.count()
        first = vectors.where(F.size(vec_col) > 0).select(F.size(vec_col).alias("d")).head()
        dim = first.d if first else 0
        cells = cells or max(1, min(4096, round(size**0.5)))
        share = min(1.0, 1.2 * SAMPLE / max(1, size))
        fit = vectors.where(F.size(vec_col) == dim).sample(share, seed).limit(SAMPLE).select(F.col(vec_col).cast("array<double>").alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        unit = fit.where(norm > 1e-12).select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
        known = dim and unit.limit(1).count()
        # limit leaves all of the sample in one partition.
        unit = unit.repartition(self.spark.sparkContext.defaultParallelism)
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters() if known else np.zeros((1, max(dim, 1))))
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        placed = self._placed(spread(vectors), centres, vec_col)
        # A cell's rows are dealt out to several tasks, so that a large one isn't written by one.
        split = placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(8)))
        data = self.folder.written(split, "cell")
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
        sizes = {str(r["cell"]): r["count"] for r in self.spark.read.schema(schema).parquet(data).groupBy("cell").count().collect()}
        content = {"data": data, "schema": schema.json(), "id": id_col, "vector": vec_col, "centres": centres.tolist(), "sizes": sizes, "probes": len(centres)}
        content["probes"], content["recall"] = self._probes(content, recall, k)
        return self.folder.commit(parent, content)

    @staticmethod
    def _placed(vectors: DataFrame, centres: np.ndarray, vec_col: str) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                v = _units(batch.column(batch.schema.get_field_index(vec_col)), c.shape[1])
                cell = np.where(np.abs(v).max(axis=1, initial=0) > 0, np.argmax(v @ c.T, axis=1), NOWHERE)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

        return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))

    def _rows(self, content: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(content["schema"]))).parquet(content["data"])

    def _probes(self, content: dict, recall: float, k: int) -> tuple[int, float]:
        """The least number of cells with which a sample of the index's vectors finds recall of its nearest; and what it finds."""
        rows, centres = self._rows(content), np.array(content["centres"])
        asked = rows.where(F.col("cell") != NOWHERE).orderBy(F.xxhash64(content["id"])).limit(PROBE_QUERIES)
        asked = written(asked.select(F.col(content["id"]).alias("query"), F.col(content["vector"]).cast("array<double>").alias("q")))
        best = nearest_k(rows.select(content["id"], content["vector"], "cell"), asked, k, content["id"], content["vector"]).where(F.col("cell") != NOWHERE)
        q = {r["query"]: np.array(r["q"]) for r in asked.collect()}
        order = {i: np.argsort(np.argsort(-(centres @ v))) for i, v in q.items()}  # rank of each cell for a query
        ranks = np.sort([order[r["query"]][r["cell"]] for r in best.select("query", "cell").collect()])
        if not len(ranks):
            return 1, 1.0
        least = int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1
        return least, float((ranks < least).mean())

    def search(self, queries: DataFrame, k: int, probes: int | None = None, version: int | None = None) -> DataFrame:
        """(query, id, score, rank) of k vectors for each query (query, q): the best of the cells that it opens."""
        return self._search(queries, k, probes, version)[0]

    def _search(self, queries: DataFrame, k: int, probes: int | None = None, version: int | None = None) -> tuple[DataFrame, float]:
        """The result, and the share of (query, vector) pairs that were scored in the first round."""
        content = self.folder.manifest(version)
        rows, centres = self._rows(content), np.array(content["centres"])
        dim, total = centres.shape[1], sum(content["sizes"].values())
        sizes = np.array([content["sizes"].get(str(c), 0) for c in range(len(centres))], float)
        probes = probes or content["probes"]
        fields = rows.schema
        schema = T.StructType([queries.schema["query"], T.StructField("id", fields[content["id"]].dataType), T.StructField("score", T.DoubleType())])
        read = [0.0, 0.0]

        def block_search(block: DataFrame) -> DataFrame:
            own = block.select("query", F.col("q").cast("array<double>")).collect()  # a block
            names = np.array([r[0] for r in own])
            q = np.array([r[1] if len(r[1] or ()) == dim else [0.0] * dim for r in own], float).reshape(len(own), dim)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
            # Cells in order of nearness: the given number, and more while they hold fewer than k vectors.
            held = np.cumsum(sizes[order], axis=1)
            open_ = np.maximum(probes, (held < k).sum(axis=1) + 1)
            mask = np.zeros((len(own), len(centres)), bool)
            for i, n in enumerate(open_.tolist()):
                mask[i, order[i, :n]] = True
            read[0] += float((mask * sizes).sum())
            read[1] += float(total * len(own))
            sent = self.spark.sparkContext.broadcast((names, q.T, mask))
            wanted = [NOWHERE, *np.flatnonzero(mask.any(axis=0)).tolist()]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, q, mask = sent.value
                kept = Kept(k, len(names))
                for batch in batches:
                    cell = batch.column(2).to_numpy()
                    for c in np.unique(cell).tolist():
                        some = batch.filter(pa.array(cell == c))
                        asked = np.arange(len(names)) if c == NOWHERE else np.flatnonzero(mask[:, c])
                        kept.add(np.round(_units(some.column(1), dim) @ q[:, asked], 6), asked, some.select([0]))
                if found := kept.best():
                    column, score, ids = found
                    yield from pa.table([pa.array(names[column]), ids.column(0), pa.array(score)], names=schema.names).to_batches(100_000)

            pruned = rows.where(F.col("cell").isin(wanted)).select(content["id"], content["vector"], "cell")
            return pruned.mapInArrow(run, schema)

        found = top_k(in_blocks(queries, "query", block_search, 8 * dim + len(centres)), k, "query", "score", "id")
        return found, read[0] / max(1.0, read[1])
