"""Conversations: windows, compaction, references, quality. Turns are the clock of a conversation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import desk
from sparkloom.functions.json import checked_record
from sparkloom.functions.policies import compliance_cost, importance, quality
from sparkloom.operators.scan import running
from sparkloom.plans._registry import query, sql_query

LEN = "CAST(floor(length(text) / 4) AS BIGINT)"


@query("SELECT conv_id, turn, tokens, used FROM (SELECT conv_id, turn, length(text) // 4 AS tokens, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM conversations) WHERE used <= 450")
def conversation_window(t):
    """The newest messages that fit 500 tokens less 50 for the frame."""
    m = t("conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("tokens"))
    return m.withColumn("used", F.sum("tokens").over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("used <= 450")


@query("WITH p AS (SELECT conv_id, turn, string_split(trim(lower(text)), ' ') AS w, lower(text) AS low FROM conversations), ph AS (SELECT DISTINCT conv_id, turn, array_to_string(w[i:i + 2], ' ') AS phrase FROM p, unnest(range(1, len(w) - 1, 3)) AS u(i) WHERE len(w) >= 3) SELECT DISTINCT ph.conv_id, ph.turn FROM ph JOIN p ON p.conv_id = ph.conv_id AND p.turn > ph.turn AND contains(p.low, ph.phrase)")
def message_references(t):
    """Messages of which a later one of the conversation holds three words in a row (every third start). The middle word of such a
    phrase stands between blanks wherever the phrase is; the first one ends the word before it, the last one begins the word after it. So each different
    run of three words is met once, by the ends that have the lengths of the phrases with its middle word, and no text goes along. The joins are
    by shuffle: to Spark the rows of words look as small as the table's files, and it would send them to all tasks."""
    m = t("conversations").select("conv_id", "turn", F.split(F.trim(F.lower("text")), " ").alias("w"), F.split(F.lower("text"), " ").alias("low"))
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.size("w") - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    inner = F.when(F.size("low") >= 3, F.sequence(F.lit(1), F.size("low") - 2)).otherwise(F.array().cast("array<int>"))
    three = lambda words: lambda i: F.struct(F.element_at(words, i).alias("first"), F.element_at(words, i + 1).alias("middle"), F.element_at(words, i + 2).alias("last"))
    own = m.select("conv_id", F.col("turn").alias("said"), F.inline(F.array_distinct(F.transform(starts, three("w")))))
    heard = m.select("conv_id", "turn", F.inline(F.transform(inner, three("low")))).groupBy("conv_id", "middle", "first", "last").agg(F.max("turn").alias("turn"))
    lengths = own.groupBy("conv_id", "middle").agg(F.collect_set(F.struct(F.length("first").alias("a"), F.length("last").alias("b"))).alias("lengths"))
    ends = heard.join(lengths.hint("merge"), ["conv_id", "middle"]).select("*", F.inline("lengths")).where((F.length("first") >= F.col("a")) & (F.length("last") >= F.col("b")))
    ends = ends.select("conv_id", "middle", F.right("first", F.col("a")).alias("first"), F.left("last", F.col("b")).alias("last"), "turn")
    last_heard = ends.groupBy("conv_id", "middle", "first", "last").agg(F.max("turn").alias("turn"))
    met = own.join(last_heard.hint("merge"), ["conv_id", "middle", "first", "last"]).where(F.col("turn") > F.col("said"))
    return met.select("conv_id", F.col("said").alias("turn")).distinct()


sql_query("last_n_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {conversations}) WHERE back <= 10")
sql_query(
    "compaction_split",
    """
    SELECT conv_id, turn, CASE WHEN back <= greatest(10, CAST(floor(n / 3) AS BIGINT)) THEN 'keep' ELSE 'compact' END AS part
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n
      FROM {conversations})
    """,
)
sql_query(
    "conversation_summary",
    """
    SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS customer_messages, count(*) AS messages, count(DISTINCT role) AS n_roles, max(turn) - min(turn) AS duration
    FROM {conversations}
    GROUP BY conv_id
    """,
)
sql_query(
    "response_gaps",
    """
    SELECT conv_id, turn, nxt - turn AS gap
    FROM (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
      FROM {conversations})
    WHERE role = 'user' AND nxt IS NOT NULL
    """,
)
sql_query("status_transitions", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS from_role, role AS to_role FROM {conversations}")
sql_query(
    "escalation_flags",
    """
    SELECT conv_id, turn, MATCHES(lower(text), '(^|[^a-z0-9_])(supervisor|escalate|escalation)($|[^a-z0-9_])') AS asks, MATCHES(lower(text), '(speak|talk|transfer|connect)[^.]{0,20}(human|agent|manager|person)') AS wants_human
    FROM {conversations}
    """,
)
REFERENCES = """
p AS (SELECT conv_id, turn, string_split(trim(lower(text)), ' ') AS w, lower(text) AS low FROM conversations),
ph AS (SELECT DISTINCT conv_id, turn, array_to_string(w[i:i + 2], ' ') AS phrase FROM p, unnest(range(1, len(w) - 1, 3)) AS u(i) WHERE len(w) >= 3),
referenced AS (SELECT DISTINCT ph.conv_id, ph.turn FROM ph JOIN p ON p.conv_id = ph.conv_id AND p.turn > ph.turn AND contains(p.low, ph.phrase))
"""


@query(f"""
WITH {REFERENCES}
SELECT c.conv_id, c.turn, round(greatest(0, least(1, 0.5::DOUBLE
  + 0.2 * (regexp_matches(text, 'important', 'i')::INT + regexp_matches(text, 'remember', 'i')::INT + regexp_matches(text, 'critical', 'i')::INT
    + regexp_matches(text, 'must[ \\t\\n\\r\\f\\v]+(have|do|be)', 'i')::INT + regexp_matches(text, 'requirement', 'i')::INT)
  - 0.3 * (regexp_matches(text, '^(ok|okay|thanks|thank you|got it)[.]?$', 'i')::INT + regexp_matches(text, '^(yes|no|sure)[.]?$', 'i')::INT)
  + CASE WHEN length(text) // 4 > 100 THEN 0.1 ELSE 0 END + CASE WHEN r.turn IS NOT NULL THEN 0.25 ELSE 0 END)), 6) AS importance
FROM conversations c LEFT JOIN referenced r ON r.conv_id = c.conv_id AND r.turn = c.turn
""")
def importance_score(t):
    """The tables have no tool calls. The references meet their messages by shuffle, as there is a row for each message."""
    referenced = message_references(t).withColumn("referenced", F.lit(True)).hint("merge")
    m = t("conversations").join(referenced, ["conv_id", "turn"], "left")
    score = importance(F.col("text"), F.floor(F.length("text") / 4), F.lit(False), F.coalesce("referenced", F.lit(False)))
    return m.select("conv_id", "turn", F.round(score, 6).alias("importance"))


@query("""
WITH m AS (
  SELECT conv_id, turn, role, lower(text) AS low,
    regexp_extract_all(text, '\\b[0-9]{13,16}\\b') AS runs FROM conversations
), cost AS (
  SELECT conv_id, turn, role, low,
    CASE WHEN len(list_filter(runs, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 1 THEN (x[i]::INT * 2) // 10 + (x[i]::INT * 2) % 10 ELSE x[i]::INT END)) % 10 = 0)) > 0 THEN 50 ELSE 0 END
    + 10 * (contains(low, 'i promise')::INT + contains(low, 'definitely')::INT + contains(low, 'always')::INT + contains(low, 'never fails')::INT) AS cost
  FROM m
), c AS (
  SELECT conv_id, count(*) AS n, (max(turn) - min(turn)) * 60 AS seconds, sum(cost) AS cost, max_by(role, turn) = 'assistant' AS resolved,
    bool_or(contains(low, 'supervisor') OR contains(low, 'escalat')) AS escalated FROM cost GROUP BY conv_id
)
SELECT conv_id, round(0.3 * greatest(0, 100.0::DOUBLE - CASE WHEN escalated THEN 30 ELSE 0 END - CASE WHEN resolved THEN 0 ELSE 50 END) + 0.25 * 50
  + 0.15 * greatest(0, 100.0::DOUBLE - CASE WHEN seconds > 600 THEN 20 ELSE 0 END - CASE WHEN seconds > 900 THEN 20 ELSE 0 END - least(100, 2 * greatest(0, n - 15)))
  + 0.15 * 50 + 0.15 * greatest(0, 100.0::DOUBLE - cost), 4) AS score
FROM c
""")
def quality_score(t):
    """A conversation that the assistant ends counts as resolved, a turn as a minute, its mood as even; the tables have no transfers."""
    low = F.lower("text")
    m = t("conversations").select("conv_id", "turn", "role", compliance_cost(F.col("text")).alias("cost"), (F.contains(low, F.lit("supervisor")) | F.contains(low, F.lit("escalat"))).alias("escalated"))
    c = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), ((F.max("turn") - F.min("turn")) * 60).alias("seconds"), F.sum("cost").alias("cost"), (F.max_by("role", "turn") == "assistant").alias("resolved"), F.bool_or("escalated").alias("escalated"))
    score = quality(F.col("resolved"), F.col("escalated"), F.lit(0), F.col("seconds"), F.col("n"), F.lit(0.0), F.col("cost"))
    return c.select("conv_id", F.round(score, 4).alias("score"))


sql_query(
    "format_context",
    """
    SELECT conv_id, listagg(concat('[', CAST(turn AS STRING), '] (', role, '): ', text), '|') WITHIN GROUP ( ORDER BY turn) AS context
    FROM {conversations}
    GROUP BY conv_id
    """,
    "SELECT conv_id, string_agg(concat('[', turn::VARCHAR, '] (', role, '): ', text), '|' ORDER BY turn) AS context FROM conversations GROUP BY conv_id",
)


@query("""
SELECT doc_id, tokens, used FROM (
  SELECT doc_id, tokens, (sum(tokens) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS used
  FROM (SELECT doc_id, source, n_chars, length(text) // 4 AS tokens FROM documents)) WHERE used <= 2000
""")
def context_budget(t):
    """Documents of a source, short ones first, while their tokens fit; the prefix grows, so the first that doesn't fit ends it."""
    sized = t("documents").select("doc_id", "source", "n_chars", F.floor(F.length("text") / 4).alias("tokens"))
    return running(sized, ["source"], ["n_chars", "doc_id"], {"used": F.col("tokens")}).where("used <= 2000").select("doc_id", "tokens", "used")


INTENT = """CASE WHEN contains(low, 'refund') THEN 'return_refund' WHEN contains(low, 'charge') THEN 'billing_dispute' WHEN contains(low, 'bill') THEN 'billing_inquiry' WHEN contains(low, 'order') THEN 'order_status'
  WHEN contains(low, 'error') THEN 'technical_support' WHEN contains(low, 'password') THEN 'account_management' WHEN contains(low, 'supervisor') THEN 'complaint' WHEN contains(low, 'suggest') THEN 'feedback' WHEN contains(low, 'the') THEN 'general_inquiry' ELSE 'other' END"""


@query(f"""
SELECT conv_id, turn, CASE {INTENT} WHEN 'return_refund' THEN 'order' WHEN 'order_status' THEN 'order' WHEN 'billing_dispute' THEN 'billing' WHEN 'billing_inquiry' THEN 'billing' WHEN 'account_management' THEN 'billing'
  WHEN 'technical_support' THEN 'technical' WHEN 'complaint' THEN 'escalation' ELSE 'triage' END AS agent
FROM (SELECT *, lower(text) AS low FROM conversations) WHERE role = 'user'
""")
def intent_route(t):
    """Words stand for the classifier of intents; its intents are routed by the map."""
    low = t("conversations").where("role = 'user'").withColumn("low", F.lower("text"))
    return low.select("conv_id", "turn", desk.agent(F.expr(INTENT)).alias("agent"))


@query(f"""
WITH c AS (SELECT conv_id, max_by({INTENT}, turn) AS intent, CASE WHEN count(*) > 4 THEN 'enterprise' ELSE 'basic' END AS tier, avg(CASE WHEN role = 'user' THEN -0.6 ELSE -0.3 END) AS mood,
  CASE count(*) % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 3 THEN 'normal' WHEN 4 THEN 'low' END AS priority
  FROM (SELECT *, lower(text) AS low FROM conversations) GROUP BY conv_id),
s AS (SELECT *, list_filter([CASE WHEN intent IN ('billing_dispute', 'billing_inquiry') THEN 'billing_specialist' END, CASE WHEN intent = 'technical_support' THEN 'technical_specialist' END,
  CASE WHEN intent = 'order_status' THEN 'order_specialist' END, CASE WHEN tier = 'enterprise' THEN 'enterprise_support' END, CASE WHEN mood < -0.5 THEN 'de_escalation' END], lambda x: x IS NOT NULL) AS found FROM c)
SELECT conv_id, CASE WHEN len(found) = 0 THEN 'general_support' ELSE array_to_string(found, ',') END AS skills,
  CASE priority WHEN 'critical' THEN 'Less than 1 minute' WHEN 'urgent' THEN '1-2 minutes' WHEN 'high' THEN '2-5 minutes' WHEN 'low' THEN '10-15 minutes' ELSE '5-10 minutes' END AS wait
FROM s
""")
def required_skills(t):
    """A conversation's last intent, a tier by its length, a mood by how much the user says, a priority by its number of turns."""
    c = t("conversations").withColumn("low", F.lower("text")).groupBy("conv_id").agg(
        F.max_by(F.expr(INTENT), "turn").alias("intent"), F.when(F.count(F.lit(1)) > 4, "enterprise").otherwise("basic").alias("tier"), F.avg(F.when(F.col("role") == "user", -0.6).otherwise(-0.3)).alias("mood"), F.count(F.lit(1)).alias("n")
    )
    priority = F.get(F.array(*[F.lit(p) for p in ("critical", "urgent", "high", "normal", "low")]), (F.col("n") % 6).cast("int"))
    return c.select("conv_id", F.array_join(desk.skills(F.col("intent"), F.col("tier"), F.col("mood")), ",").alias("skills"), desk.wait_time(priority).alias("wait"))


@query("""
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'messages is no list' WHEN conv_id % 7 = 1 THEN 'id is missing' WHEN conv_id % 7 = 2 THEN 'no object' END AS error,
  CASE WHEN conv_id % 7 IN (0, 2) THEN 0 ELSE count(*) END AS n_messages, CASE WHEN conv_id % 7 IN (0, 2) THEN 0 ELSE count(*) FILTER (turn % 5 <> 3 AND text IS NOT NULL AND role IS NOT NULL) END AS n_kept
FROM conversations GROUP BY conv_id
""")
def validate_state(t):
    """Conversations as records in JSON, some without a list of messages, without an id, or cut off; every fifth message has no role. Of a
    record what is sound is kept."""
    n = F.col("conv_id") % 7
    message = F.when(F.col("turn") % 5 == 3, F.to_json(F.struct("turn", "text"))).otherwise(F.to_json(F.struct("turn", "role", "text")))
    c = t("conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(message)), ",").alias("list"))
    id_part = F.when(n == 1, F.lit("{")).otherwise(F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit(", ")))
    body = F.when(n == 0, F.lit('"messages": 5}')).otherwise(F.concat(F.lit('"messages": ['), "list", F.lit("]}")))
    text = F.when(n == 2, F.lit('{"id": 1, "mess')).otherwise(F.concat(id_part, body))
    return c.select("conv_id", *[v.alias(k) for k, v in checked_record(text).items()])
