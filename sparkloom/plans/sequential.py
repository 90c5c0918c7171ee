"""Queries that need Python or a stream; SQL says those that it can."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions.embedding import code_vectors, word_codes
from sparkloom.functions.embedding import hash_embed as embed
from sparkloom.operators import chunking as C
from sparkloom.operators import sequential as S
from sparkloom.operators.ingest import ChunkStore
from sparkloom.plans._registry import ORACLE_SQL, QUERIES, query
from sparkloom.sources.folders import new_folder
from sparkloom.sources.tables import spread, tables
from sparkloom.streaming.counters import hourly_counters
from sparkloom.streaming.lifecycle import life_cycle_stream

#: Time of writing of the queries that write.
NOW = datetime(2024, 1, 1)

SENTENCES = r"""
string_split(
  regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+([A-Z])', '\1' || chr(1) || '\2', 'g'), '(\n)\n+', '\1' || chr(1), 'g'),
  chr(1))
"""


@query()
def chunk_fixed(t):
    return C.fixed_chunks(t("documents"))


@query(f"""
SELECT doc_id, len(s) AS n_sentences, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars FROM (
  SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS s FROM documents)
WHERE len(s) > 0
""")
def split_sentences(t):
    s = t("documents").select("doc_id", C.sentences(F.col("text")).alias("s")).where("size(s) > 0")
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.expr("aggregate(s, 0L, (a, x) -> a + length(x))").alias("chars"))


@query()
def chunk_sentence(t):
    return C.sentence_chunks(t("documents"))


@query()
def chunk_semantic(t):
    """Sentences are embedded by hashing. A document is a row throughout, so those without an id, or with the same one, stay apart; its
    vectors are made in the task that cuts it, of the codes of its words."""
    s = spread(t("documents").select("doc_id", "text")).select("doc_id", C.sentences(F.col("text"), C.ANY_SENTENCE_END).alias("sentences"))
    return C.semantic_chunks(s.withColumn("codes", F.transform("sentences", word_codes)), vector_col="codes", embed=code_vectors)


@query()
def chunk_hierarchical(t):
    return C.hierarchical_chunks(t("documents"))


@query()
def chunk_parents(t):
    return C.with_children(C.hierarchical_chunks(t("documents"))).select("doc_id", "chunk_id", "place", "child_ids")


@query()
def hash_embed(t):
    return embed(t("documents").select("doc_id", "text")).select("doc_id", "embedding")


@query()
def kb_ingest(t):
    """All documents are loaded into a new store."""
    docs = t("documents")
    return ChunkStore(docs.sparkSession, new_folder(docs.sparkSession, "kb")).load(docs, NOW)


@query()
def budget_admission(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = o.select(F.col("c_mktsegment").alias("cost_center"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return S.admit(own, 1_000_000.0, 5_000_000.0).select("cost_center", "id", "admitted", F.round("spent_day", 2).alias("spent_day"), F.round("spent_month", 2).alias("spent_month"))


def _seconds(name: str = "ts"):
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6


def task_events(t):
    """A user's events drive a task: views claim it, errors fail it, purchases complete it, clicks pause and signups resume it."""
    names = F.create_map(*[F.lit(x) for x in ("view", "claim", "error", "fail", "purchase", "complete", "click", "pause", "signup", "resume")])
    return t("events").select(F.col("user_id").alias("task_id"), _seconds().alias("at"), F.col("event_id").alias("id"), names[F.col("event_type")].alias("event"))


@query()
def task_lifecycle(t):
    return S.life_cycle(task_events(t)).select("task_id", "id", "event", "status", "attempt", "accepted")


@query()
def scaling_replay(t):
    """Hours of events as readings of one pool."""
    h = t("events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).cast("int").alias("depth"), (F.avg("value") * 40).alias("latency_ms"), F.count_if(F.col("value") < 10).cast("int").alias("idle"))
    m = h.select(F.lit("all").alias("pool"), _seconds("hour").alias("at"), "depth", "latency_ms", "idle")
    return S.autoscale(m, S.Scaling(up_depth=8, per_worker=3)).select("at", "change", "workers")


@query()
def circuit_replay(t):
    e = t("events").select(F.col("user_id").alias("provider"), _seconds().alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))
    return S.circuit_breaker(e, threshold=2, open_seconds=86_400.0).select("id", "allowed", "failures")


@query()
def checkpoint_adaptive(t):
    e = t("events").select(F.col("user_id").alias("task_id"), _seconds().alias("at"), F.col("event_id").alias("id"), F.col("value").alias("cost"))
    return S.checkpoints(e, 3600.0, 86_400.0, 50.0).select("id", "checkpoint")


@query()
def semantic_cache_replay(t):
    """Vectors come in order of their number, a second apart, to one cache for each label."""
    e = t("embeddings").select(F.col("label").alias("shard"), F.col("vec_id").cast("double").alias("at"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = S.replay_semantic_cache(e, S.CacheRules(threshold=0.4, same=0.9, near_miss=0.3, ttl=1e9, entries=40))
    return found.select("id", "hit", F.round("similarity", 6).alias("similarity"), "matched", "near_miss")


QUERIES["stream_hourly_counters"] = lambda spark, sf_dir: hourly_counters(spark, f"{sf_dir}/events.parquet")
ORACLE_SQL["stream_hourly_counters"] = "SELECT CAST(date_trunc('hour', ts) AS STRING) AS hour, event_type AS metric, count(*) AS n FROM events GROUP BY 1, 2"


def task_lifecycle_stream(spark, sf_dir):
    """task_lifecycle's events as a stream: their files are read in batches, and a state is kept for each task."""
    name, path = "spark.sql.streaming.stateStore.providerClass", new_folder(spark, "tasks")
    events = task_events(tables(spark, sf_dir))
    events.select("task_id", "at", "id", "event").where("event IS NOT NULL").repartitionByRange(3, "at", "id").sortWithinPartitions("at", "id").write.parquet(f"{path}/in")
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("task_id bigint, at double, id bigint, event string").option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
        out = life_cycle_stream(source).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}"))
        out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    schema = "task_id bigint, at double, id bigint, event string, status string, attempt int, accepted boolean, late boolean"
    return spark.read.schema(schema).parquet(f"{path}/out").select("task_id", "id", "event", "status", "attempt", "accepted")


QUERIES["task_lifecycle_stream"] = task_lifecycle_stream
