"""Text and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators.rules import matching, multi_get, within_limit
from sparkloom.plans._registry import query, sql_query
from sparkloom.sources.tables import spread

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

BM25 = rf"""
WITH w AS (SELECT doc_id AS doc, lang, {WORDS} AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM w),
p AS (SELECT doc, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({WORDS}) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
bm AS (SELECT query, doc, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM p JOIN d USING (term) JOIN q USING (term), st GROUP BY query, doc)
"""


def searches(t):
    return t("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), "text")


def bm25(t):
    return R.bm25(t("documents"), searches(t))


@query(rf"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def tokenize(t):
    w = spread(t("documents")).select("doc_id", R.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(rf"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def bm25_stats(t):
    return R.term_stats(t("documents"))


@query(BM25 + "SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(t):
    return R.top_k(bm25(t), 10, "query", "score", "doc")


@query(BM25 + "SELECT query, doc, score, rank FROM (SELECT bm.*, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm JOIN w USING (doc) WHERE lang = 'en') WHERE rank <= 10")
def bm25_topk_filtered(t):
    """Statistics stay those of the whole corpus."""
    english = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return R.top_k(bm25(t).join(english, "doc", "left_semi"), 10, "query", "score", "doc").select("query", "doc", "score", "rank")


@query(r"""SELECT doc_id, len(list_filter(runs, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 1 THEN (x[i]::INT * 2) // 10 + (x[i]::INT * 2) % 10 ELSE x[i]::INT END)) % 10 = 0))::BIGINT AS n_valid, len(runs)::BIGINT AS n_runs
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{13,16}') AS runs FROM documents)""")
def luhn_pan(t):
    runs = t("documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]{13,16}"), F.lit(0)).alias("runs"))
    return runs.select("doc_id", F.size(F.filter("runs", lambda x: F.call_function('luhn_check', x))).cast("long").alias("n_valid"), F.size("runs").cast("long").alias("n_runs"))


@query("SELECT doc_id, o // 800 + 1 AS chunk, o AS start_char, least(o + 1000, length(text)) AS end_char, sha256(substr(text, o + 1, 1000)) AS content_sha256 FROM documents, unnest(range(0, greatest(length(text), 1), 800)) AS u(o)")
def chunk_fixed_simple(t):
    """Chunks of 1,000 characters that overlap by 200."""
    d = t("documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(800))).alias("o"))
    return d.select("doc_id", F.expr("o div 800 + 1").alias("chunk"), F.col("o").cast("long").alias("start_char"), F.least(F.col("o") + 1000, F.length("text")).cast("long").alias("end_char"), F.sha2(F.substring("text", F.col("o") + 1, F.lit(1000)).cast("binary"), 256).alias("content_sha256"))


sql_query("extract_email", r"SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+', 0), '') AS email FROM {documents}", r"SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+', 0), '') AS email FROM documents")
sql_query(
    "identifier_type",
    """
    SELECT c_custkey, CASE WHEN contains(id, '@') THEN 'email' WHEN regexp_replace(id, '[-+]', '') RLIKE '^[0-9]+$' THEN 'phone' ELSE 'account_number' END AS kind
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@x.y') WHEN c_custkey % 3 = 1 THEN concat('+1-', CAST(c_custkey AS STRING)) ELSE c_name END AS id
      FROM {customer})
    """,
    """
    SELECT c_custkey, CASE WHEN contains(id, '@') THEN 'email' WHEN regexp_matches(regexp_replace(id, '[-+]', '', 'g'), '^[0-9]+$') THEN 'phone' ELSE 'account_number' END AS kind
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@x.y') WHEN c_custkey % 3 = 1 THEN concat('+1-', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS id
      FROM customer)
    """,
)
sql_query("token_estimate", "SELECT doc_id, CAST(length(text) div 4 AS BIGINT) AS by_chars, CAST(floor(size(filter(split(text, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')) * 1.3D) AS BIGINT) AS by_words FROM {documents}", r"SELECT doc_id, (length(text) // 4)::BIGINT AS by_chars, floor(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) * 1.3::DOUBLE)::BIGINT AS by_words FROM documents")
sql_query("snippet", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS snippet FROM {documents}")
sql_query("cache_key", r"SELECT doc_id, concat('llm:', sha2(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ')), 256)) AS cache_key, substr(sha2(concat('lang=', lang, '|source=', source), 256), 1, 16) AS tool_key FROM {documents}", r"SELECT doc_id, concat('llm:', sha256(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS cache_key, substr(sha256(concat('lang=', lang, '|source=', source)), 1, 16) AS tool_key FROM documents")
LIMBS = [f"CAST(conv(substr(h, {i}, 8), 16, 10) AS BIGINT)" for i in (1, 9, 17, 25)]
FOLD = "(({0} % 7 * (4294967296 % 7) + {1}) % 7 * (4294967296 % 7) + {2}) % 7 * (4294967296 % 7) + {3}".format(*LIMBS)
sql_query("shard_route", f"SELECT c_custkey, ({FOLD}) % 7 AS shard FROM (SELECT c_custkey, md5(CAST(c_custkey AS STRING)) AS h FROM {{customer}})", "SELECT c_custkey, ((({0} % 7 * (4294967296 % 7) + {1}) % 7 * (4294967296 % 7) + {2}) % 7 * (4294967296 % 7) + {3}) % 7 AS shard FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS h FROM customer)".format(*[f"('0x' || substr(h, {i}, 8))::BIGINT" for i in (1, 9, 17, 25)]))
sql_query(
    "metric_component",
    """
    SELECT DISTINCT name, CASE WHEN name = '' THEN 'unknown' ELSE left(regexp_replace(name, '[^A-Za-z0-9_.-]', '_'), 80) END AS component
    FROM (SELECT concat(p_type, '/', p_brand, ' ', p_name) AS name
      FROM {part})
    """,
    """
    SELECT DISTINCT name, CASE WHEN name = '' THEN 'unknown' ELSE left(regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g'), 80) END AS component
    FROM (SELECT concat(p_type, '/', p_brand, ' ', p_name) AS name
      FROM part)
    """,
)
sql_query("kb_stats", "SELECT source, lang, count(*) AS n_documents, sum(n_chars) AS n_chars FROM {documents} GROUP BY source, lang", "SELECT source, lang, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source, lang")
sql_query("kv_glob_scan", r"SELECT DISTINCT source AS name FROM {documents} WHERE source RLIKE '^src1.*$'", "SELECT DISTINCT source AS name FROM documents WHERE regexp_matches(source, '^src1.*$')")
sql_query("glob_delete", r"SELECT doc_id, source FROM {documents} WHERE NOT source RLIKE '^src1.$'", "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(source, '^src1.$')")
sql_query(
    "index_sync",
    """
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'added' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change
    FROM (SELECT doc_id, sha2(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END, 256) AS h
      FROM {documents}
      WHERE doc_id % 5 <> 0) a
    FULL OUTER JOIN (SELECT doc_id, sha2(text, 256) AS h
      FROM {documents}
      WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id
    """,
    """
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'added' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change
    FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h
      FROM documents
      WHERE doc_id % 5 <> 0) a
    FULL OUTER JOIN (SELECT doc_id, sha256(text) AS h
      FROM documents
      WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id
    """,
)
sql_query("cache_warm_missing", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def ids_by_metadata(t):
    """A scan by metadata that would give over a million ids is refused, not cut."""
    found = t("documents").where(matching({"lang": "en", "source": "src3"})).select("doc_id")
    return within_limit(found, 1_000_000)


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_multi_get(t):
    """Values of all documents' keys in bulk; null for those that aren't there."""
    return multi_get(t("labels").select("doc_id", "quality", "toxic"), t("documents").select("doc_id"), "doc_id", 1_000_000_000)
