"""Vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators.cells import CellIndex
from sparkloom.operators.rules import matching
from sparkloom.plans._registry import query, sql_query
from sparkloom.plans.text import BM25, bm25, searches
from sparkloom.sources.folders import new_folder, written

V = "list_transform(embedding, lambda x: x::DOUBLE)"
NEAR = f"e AS (SELECT vec_id, label, {V} AS v FROM embeddings), near AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0)"
RANKED = "SELECT query, id, score, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM near{where}) WHERE rank <= {k}"
FUSE = BM25.rstrip() + f", {NEAR}, kw AS (SELECT query, doc AS id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm), ve AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM near WHERE query IN (SELECT query FROM bm)), both_sides AS (SELECT 'k' AS side, * FROM kw WHERE rank <= 20 UNION ALL SELECT 'v', * FROM ve WHERE rank <= 20)"


def asked(t):
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), R.doubles(F.col("embedding")).alias("q"))


def best(t, k: int, must: dict | None = None, others_only: bool = False):
    found = R.nearest_k(t("embeddings").where(matching(must or {})), asked(t), k, others_only=others_only)
    return found.select("query", "id", "score", "label", "rank")


@query(f"WITH {NEAR} " + RANKED.format(where="", k=10))
def vector_topk(t):
    return best(t, 10)


@query(f"WITH {NEAR} " + RANKED.format(where=" WHERE label = 3", k=5))
def vector_topk_filtered(t):
    return best(t, 5, {"label": 3})


@query(f"WITH {NEAR} " + RANKED.format(where=" WHERE label >= 5 AND id >= 100", k=5))
def vector_topk_range_filter(t):
    return best(t, 5, {"label": (5, None), "vec_id": (100, None)})


@query(f"WITH e AS (SELECT vec_id, label, {V} AS v FROM embeddings) SELECT b.vec_id, round(1 - (1 - list_cosine_similarity(a.v, b.v)), 6) AS similarity FROM e a, e b WHERE a.vec_id = 0 AND b.label = 2 ORDER BY 2 DESC, 1 LIMIT 5")
def pgvector_topk(t):
    one = t("embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query"), R.doubles(F.col("embedding")).alias("q"))
    return R.nearest_k(t("embeddings").where("label = 2"), one, 5).select(F.col("id").alias("vec_id"), F.col("score").alias("similarity"))


@query(f"WITH {NEAR} SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM near WHERE id <> query) WHERE rank = 1 AND score >= 0.35")
def semantic_cache_lookup(t):
    return best(t, 1, others_only=True).where("score >= 0.35D").select("query", "id", "score")


@query(f"WITH {NEAR} SELECT query, CASE WHEN score >= 0.95 THEN id END AS id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM near WHERE id <> query) WHERE rank = 1")
def semantic_lookup_quality(t):
    return best(t, 1, others_only=True).select("query", F.when(F.col("score") >= 0.95, F.col("id")).alias("id"), "score")


@query(f"WITH {NEAR} SELECT id, score, query FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query, rank) AS first FROM ({RANKED.format(where='', k=10)})) WHERE first = 1) WHERE r2 <= 20")
def multi_query_merge(t):
    """The first hit of each id over the queries in order, then the 20 best."""
    from pyspark.sql import Window as W

    hits = best(t, 10).withColumn("first", F.row_number().over(W.partitionBy("id").orderBy("query", "rank"))).where("first = 1")
    return hits.select("id", "score", "query").orderBy(F.desc("score"), "id").limit(20)


def sides(t):
    """The 20 best of each side, for the queries that have a text and a vector."""
    queries = asked(t).join(F.broadcast(t("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"))), "query", "left_semi")
    kw = R.top_k(bm25(t).select("query", F.col("doc").alias("id"), "score"), 20, "query", "score", "id")
    ve = R.nearest_k(t("embeddings"), queries, 20).select("query", "id", "score", "rank")
    return kw.withColumn("side", F.lit("k")).unionByName(ve.withColumn("side", F.lit("v")))


@query(FUSE + " SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_sides GROUP BY query, id)) WHERE rank <= 10")
def hybrid_rrf(t):
    return R.top_k(R.rrf(sides(t)), 10, "query", "score", "id")


@query(FUSE + ", sc AS (SELECT side, query, id, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END) AS s FROM both_sides WINDOW w AS (PARTITION BY query, side)) SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, round(sum(CASE side WHEN 'v' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * s), 6) AS score FROM sc GROUP BY query, id)) WHERE rank <= 10")
def hybrid_linear(t):
    scaled = R.min_max(sides(t), ["query", "side"])
    part = F.when(F.col("side") == "v", F.lit(0.7)).otherwise(F.lit(0.3)) * F.col("scaled")
    return R.top_k(scaled.groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("score")), 10, "query", "score", "id")


@query(f"SELECT label, pos::INT AS pos, round(avg(v[pos]), 6) AS mean FROM (SELECT label, {V} AS v FROM embeddings), unnest(range(1, 65)) AS u(pos) GROUP BY label, pos")
def vector_centroid(t):
    return t("embeddings").select("label", F.posexplode(R.doubles(F.col("embedding")))).groupBy("label", (F.col("pos") + 1).alias("pos")).agg(F.round(F.avg("col"), 6).alias("mean"))


@query(f"WITH {NEAR} SELECT query, label, round(least(avg(score), 1.0), 5) AS confidence FROM near GROUP BY query, label")
def rag_confidence(t):
    mean = R.mean_scores(t("embeddings"), asked(t), "label")
    return mean.select("query", "label", F.round(F.least("score", F.lit(1.0)), 5).alias("confidence"))


sql_query("lsh_bucket", "SELECT vec_id, sha2(array_join(transform(slice(embedding, 1, 64), x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), ''), 256) AS bucket FROM {embeddings}", "SELECT vec_id, sha256(array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')) AS bucket FROM embeddings")
@query("SELECT vec_id, len(embedding)::INT AS dim, list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 4)) AS head FROM embeddings")
def embedding_preview(t):
    """A small negative value is rounded to -0.0, as in DuckDB; Spark's round knows one zero only."""
    rounded = lambda x: F.signum(x) * F.round(F.abs(x), 4)
    return t("embeddings").select("vec_id", F.size("embedding").alias("dim"), F.transform(F.slice(R.doubles(F.col("embedding")), 1, 8), rounded).alias("head"))


def ann_search_of(t):
    """The ten nearest by an index of cells that is made of all vectors first."""
    e = t("embeddings")
    index = CellIndex(e.sparkSession, new_folder(e.sparkSession, "cells"))
    index.build(e)
    return index.search(asked(t), 10)


@query()
def ann_search(t):
    return ann_search_of(t)


@query()
def ann_recall(t):
    """How many of each query's ten nearest the index finds."""
    exact = best(t, 10).select("query", "id")
    found = exact.join(ann_search_of(t).select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return found.groupBy("query").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))


@query(BM25.rstrip() + """,
first AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm),
sets AS (SELECT query, list(term) AS terms FROM q GROUP BY query),
again AS (
  SELECT query, doc AS id, score AS original_score,
    round(len(list_filter(terms, lambda x: list_contains(w, x))) / len(terms)::DOUBLE, 6) AS score
  FROM first JOIN w USING (doc) JOIN sets USING (query) WHERE rank <= 200)
SELECT query, id, score, original_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, original_score DESC, id) AS rank FROM again) WHERE rank <= 10
""")
def rerank(t):
    """The 200 best by BM25, ordered anew by the share of the query's words that are in the text."""
    first = R.top_k(bm25(t), 200, "query", "score", "doc").withColumnRenamed("doc", "id")
    first = written(first)  # at most 200 rows a query: their documents are picked before texts are cut
    picked = t("documents").join(F.broadcast(first.select(F.col("id").alias("doc_id")).distinct()) if first.count() <= 100_000 else first.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = picked.select(F.col("doc_id").alias("id"), F.array_distinct(R.tokens(F.col("text"))).alias("own"))
    asked_words = searches(t).select("query", F.array_distinct(R.tokens(F.col("text"))).alias("terms"))
    both = first.join(texts, "id").join(F.broadcast(asked_words), "query")
    share = F.round(F.size(F.array_intersect("terms", "own")) / F.size("terms"), 6)
    return R.rerank(both, share, 10).select("query", "id", "score", "original_score", "rank")


@query(f"""
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm, round(v[1] / sqrt(list_sum(list_transform(v[1:32], lambda x: x * x))), 5) AS first,
  CASE WHEN vec_id % 10 = 3 THEN 'vector is too short' WHEN vec_id % 10 = 4 THEN 'vector is zero' END AS error
FROM (SELECT vec_id, {V} AS v FROM embeddings)
""")
def matryoshka_truncate(t):
    """The first 32 dimensions at length 1; of some vectors a cut one and a zeroed one are tried as well."""
    v = R.doubles(F.col("embedding"))
    tried = F.when(F.col("vec_id") % 10 == 3, F.slice(v, 1, 31)).when(F.col("vec_id") % 10 == 4, F.transform(v, lambda x: x * 0)).otherwise(v)
    half, error = R.truncated(v, 32)[0], R.truncated(tried, 32)[1]
    return t("embeddings").select("vec_id", F.round(F.sqrt(R.dot(v, v)), 5).alias("norm"), F.round(half[0], 5).alias("first"), error.alias("error"))
