"""Queries that write: stored indexes, keyed tables, ledgers and rollups; and merges and migrations of states. Each begins with an empty folder."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import migrate as MG
from sparkloom.operators.ingest import ChunkStore
from sparkloom.operators.postings import InvertedIndex
from sparkloom.operators.replicas import merge_replicas
from sparkloom.operators.rollups import RANK_ERROR, HourlyRollups
from sparkloom.operators.store import KeyedTable
from sparkloom.plans._registry import query
from sparkloom.plans.sequential import SENTENCES
from sparkloom.plans.text import BM25, searches
from sparkloom.sources.folders import new_folder

NOW = datetime(2024, 1, 1)


def _new(t, name: str) -> tuple:
    spark = t("region").sparkSession
    return spark, new_folder(spark, name)


@query(
    BM25.replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 13 = 0 THEN text || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0))", 1)
    + "SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 10"
)
def bm25_index_topk(t):
    """An index gets two thirds of the documents, then the others and new texts for some, and loses those of every 17th id; then it is searched."""
    spark, path = _new(t, "index")
    docs = t("documents").select("doc_id", "text")
    index = InvertedIndex(spark, path)
    index.add(docs.where("doc_id % 3 <> 0"))
    twice = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    index.add(docs.where("doc_id % 3 = 0 OR doc_id % 13 = 0").select("doc_id", twice.alias("text")))
    index.delete(docs.where("doc_id % 17 = 0").select("doc_id"))
    return index.search(searches(t), 10)


def _written(t) -> tuple:
    """Customers as a table; each order is a change of its customer, and some customers get a second row."""
    spark, path = _new(t, "table")
    table = KeyedTable(spark, path, T.StructType.fromDDL("id long, v string"))
    first = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"), F.when(F.col("c_custkey") % 3 == 0, 3600.0).alias("ttl_seconds"))
    table.apply(first, NOW)
    c = F.col("o_custkey")
    expected = F.when(c % 5 == 0, 2).when(c % 2 == 0, 1).cast("long")
    changes = t("orders").select(c.alias("id"), F.col("o_orderpriority").alias("v"), F.when(c % 7 == 0, "delete").otherwise("upsert").alias("op"), F.col("o_orderkey").alias("seq"), expected.alias("expected"))
    new = t("customer").where("c_custkey % 11 = 0").select((-F.col("c_custkey") - 1).alias("id"), F.lit("new").alias("v"), F.lit("upsert").alias("op"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("expected"))
    return table, table.apply(changes.unionByName(new), NOW + timedelta(minutes=30))[0]


CHANGED = """
WITH o AS (SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS v, CASE WHEN o_custkey % 5 = 0 THEN 'conflict' WHEN o_custkey % 7 = 0 THEN 'deleted' ELSE 'updated' END AS outcome FROM orders GROUP BY o_custkey)
"""


@query(CHANGED + """
SELECT c_custkey AS id, CASE WHEN outcome = 'updated' THEN o.v ELSE c_mktsegment END AS v, CASE WHEN outcome = 'updated' THEN 2 ELSE 1 END::BIGINT AS row_version,
  outcome IS DISTINCT FROM 'updated' AND c_custkey % 3 = 0 AS expires
FROM customer LEFT JOIN o ON id = c_custkey WHERE outcome IS DISTINCT FROM 'deleted'
UNION ALL SELECT -c_custkey - 1, 'new', 1, FALSE FROM customer WHERE c_custkey % 11 = 0
""")
def kv_write_versions(t):
    """The table after both batches."""
    return _written(t)[0].read().select("id", "v", "row_version", F.col("expires_at").isNotNull().alias("expires"))


@query(CHANGED + "SELECT id, outcome, CASE outcome WHEN 'conflict' THEN 1 WHEN 'updated' THEN 2 END::BIGINT AS row_version FROM o UNION ALL SELECT -c_custkey - 1, 'inserted', 1 FROM customer WHERE c_custkey % 11 = 0")
def kv_write_outcomes(t):
    """What became of each change of the second batch."""
    return _written(t)[1]


@query("""
SELECT coalesce(b.vec_id, c.vec_id) AS vec_id, CASE WHEN c.vec_id IS NULL THEN b.label ELSE c.label END AS label,
  CASE WHEN b.vec_id IS NULL THEN 1 WHEN c.vec_id IS NULL THEN 1 ELSE 2 END AS version, round(coalesce(b.x, c.x), 6) AS first
FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings WHERE label < 7) b
FULL JOIN (SELECT vec_id, label + 100 AS label, embedding[1]::DOUBLE AS x FROM embeddings WHERE label >= 5) c ON b.vec_id = c.vec_id
""")
def vector_upsert(t):
    """A store of the vectors of seven labels takes in those of five: two are replaced, three are new."""
    spark, path = _new(t, "vectors")
    store = KeyedTable(spark, path, T.StructType.fromDDL("vec_id long, label int, embedding array<float>"))
    e = t("embeddings").select("vec_id", "label", "embedding")
    store.apply(e.where("label < 7"), NOW)
    store.apply(e.where("label >= 5").withColumn("label", F.col("label") + 100), NOW)
    return store.read().select("vec_id", "label", F.col("row_version").cast("int").alias("version"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(rf"""
WITH first AS (SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 0),
second AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN text || ' More.' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0),
both_loads AS (SELECT s.doc_id, s.text, f.doc_id IS NOT NULL AND coalesce(f.text, '') = coalesce(s.text, '') AS same FROM second s LEFT JOIN first f ON f.doc_id = s.doc_id),
last AS (SELECT doc_id, text FROM second UNION ALL SELECT doc_id, text FROM first WHERE doc_id NOT IN (SELECT doc_id FROM second)),
counted AS (SELECT doc_id, len(list_filter(list_transform({SENTENCES.strip()}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')) > 0 AS there FROM last)
SELECT c.doc_id, CASE WHEN b.doc_id IS NULL THEN NULL WHEN b.same THEN 'unchanged' WHEN c.there THEN 'loaded' ELSE 'empty' END AS status, c.there AND c.doc_id % 17 <> 0 AS current
FROM counted c LEFT JOIN both_loads b ON b.doc_id = c.doc_id
""")
def kb_incremental(t):
    """Two loads with unchanged, changed, emptied and new documents, and a deletion: the second load's status, and whether there are chunks in the end."""
    spark, path = _new(t, "kb")
    docs = t("documents").select("doc_id", "text")
    store = ChunkStore(spark, path)
    store.load(docs.where("doc_id % 4 <> 0"), NOW)
    changed = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" More."))).otherwise(F.col("text"))
    second = store.load(docs.where("doc_id % 3 <> 0").select("doc_id", changed.alias("text")), NOW).select("doc_id", "status")
    store.delete(docs.where("doc_id % 17 = 0").select("doc_id"), NOW)
    there = store.chunks().select("doc_id").distinct().withColumn("current", F.lit(True))
    every = docs.where("doc_id % 4 <> 0 OR doc_id % 3 <> 0").select("doc_id")
    return every.join(second, "doc_id", "left").join(there, "doc_id", "left").select("doc_id", "status", F.coalesce("current", F.lit(False)).alias("current"))


@query("""
SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, TRUE AS p50_fits, TRUE AS p99_fits
FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type
""")
def rollup_report(t):
    """Two loads of events become hourly rollups; a report over days comes from these alone. Its quantiles are held against the events' own
    ranks: they fit if the rank errs by no more than the sketch's bound."""
    spark, path = _new(t, "rollups")
    rolled = HourlyRollups(spark, path)
    rolled.add(t("events").where("event_id % 2 = 0"), "ts", "event_type", "value")
    rolled.add(t("events").where("event_id % 2 = 1"), "ts", "event_type", "value")
    report = rolled.report("2024-01-05 00:00:00", "2024-01-20 12:00:00", (0.5, 0.99))
    own = t("events").where("ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
    both = own.join(F.broadcast(report.select(F.col("metric").alias("event_type"), "p50", "p99")), "event_type")  # a row for each metric
    below = both.groupBy(F.col("event_type").alias("metric")).agg(*[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_low") for p in ("p50", "p99")], *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_high") for p in ("p50", "p99")])
    fits = lambda p, q: ((F.col(f"{p}_low") <= q + RANK_ERROR) & (F.col(f"{p}_high") >= q - RANK_ERROR)).alias(f"{p}_fits")
    return report.join(below, "metric").select("metric", "n", F.round("mean", 6).alias("mean"), "least", "most", fits("p50", 0.5), fits("p99", 0.99))


@query("""
WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN sum(n) FILTER (event_type = 'error') ELSE sum(n) END::BIGINT AS total,
  count(*) > 1 AND NOT bool_or(event_type = 'error') AS conflict, CASE WHEN bool_or(event_type = 'error') THEN 1 ELSE count(*) END::INT AS merged,
  sum(n)::BIGINT AS clock
FROM r GROUP BY user_id
""")
def replica_merge(t):
    """Each type of a user's events is a replica that has counted its own; that of the errors has seen all others and keeps its own count."""
    e = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    seen = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("all"))  # one entry for each type
    own = e.join(seen, "user_id").select("user_id", "event_type", F.when(F.col("event_type") == "error", F.col("all")).otherwise(F.create_map("event_type", "n")).alias("clock"), F.to_json(F.create_map(F.lit("total"), "n")).alias("state"))
    merged = merge_replicas(own, "user_id", "event_type")
    clock = F.aggregate(F.map_values("clock"), F.lit(0).cast("long"), lambda s, x: s + x)
    return merged.select("user_id", F.get_json_object("state", "$.total").cast("long").alias("total"), "conflict", "merged", clock.alias("clock"))


PATHS = [
    ("1.0", "1.1", [{"op": "default", "path": "user_preferences", "value": {"language": "en", "timezone": "UTC", "notifications_enabled": True}}]),
    ("1.1", "2.0", [{"op": "rename", "path": "size", "to": "part.size"}]), ("3.0", "3.1", []),
]


def _states(t):
    """Parts as states of versions 1.0 (unsaid), 1.1, 1.2 (from which no migration leads on), 2.0 and 2.1; some of 1.1 lack a field."""
    n = F.col("p_partkey") % 5
    versioned = F.concat(F.lit('{"_schema_version": "'), F.when(n == 1, "1.1").when(n == 2, "1.2").when(n == 3, "2.0").otherwise("2.1"), F.lit('", '))
    start = F.when(n == 0, F.lit("{")).otherwise(versioned)
    field = F.when(F.col("p_partkey") % 20 == 1, F.lit('"other": ')).otherwise(F.lit('"size": '))
    return t("part").select(F.col("p_partkey").alias("key"), F.concat(start, field, F.col("p_size").cast("string"), F.lit("}")).alias("state"))


def _migrations(t):
    return t("part").sparkSession.createDataFrame([(a, b, json.dumps(s)) for a, b, s in PATHS], "from_version string, to_version string, steps string")


@query("""
SELECT outcome, coalesce(n, 0) AS n FROM (VALUES ('migrated'), ('already_current'), ('failed')) AS o(outcome) LEFT JOIN (
  SELECT CASE WHEN p_partkey % 5 = 3 THEN 'already_current' WHEN p_partkey % 5 IN (2, 4) OR p_partkey % 20 = 1 THEN 'failed' ELSE 'migrated' END AS outcome, count(*) AS n
  FROM part GROUP BY 1) USING (outcome)
""")
def migrate_stats(t):
    """States written to a table, brought to version 2.0, and written back."""
    spark, path = _new(t, "states")
    table = KeyedTable(spark, path, T.StructType.fromDDL("key long, state string"))
    table.apply(_states(t), NOW)
    done = MG.migrate_table(table, _migrations(t), "2.0", NOW)
    return MG.counts(done)


@query("""
SELECT p_partkey AS key, CASE WHEN p_partkey % 5 IN (0, 3) OR (p_partkey % 5 = 1 AND p_partkey % 20 <> 1) THEN '2.0' WHEN p_partkey % 5 = 1 THEN '1.1' WHEN p_partkey % 5 = 2 THEN '1.2' ELSE '2.1' END AS version,
  CASE WHEN p_partkey % 5 = 0 OR (p_partkey % 5 = 1 AND p_partkey % 20 <> 1) THEN p_size END::BIGINT AS moved, CASE WHEN p_partkey % 5 = 0 THEN 'en' END AS language
FROM part
""")
def migrated_states(t):
    done = MG.migrate(_states(t), _migrations(t), "2.0", NOW)
    at = lambda p: F.get_json_object("state", p)
    return done.select("key", at("$._schema_version").alias("version"), at("$.part.size").cast("long").alias("moved"), at("$.user_preferences.language").alias("language"))
