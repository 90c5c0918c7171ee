"""Operational metrics over events: purchase is a hit, error a failure, value a latency."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import desk
from sparkloom.operators.merge import latest
from sparkloom.operators.percentiles import kth
from sparkloom.operators.rules import tune_threshold
from sparkloom.operators.scan import position, running
from sparkloom.plans._registry import query, sql_query
from sparkloom.sources.folders import written

HOUR = "CAST(date_trunc('hour', ts) AS STRING)"
SORTED = "SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY event_type"


@query(f"SELECT event_type, n, s[least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1] AS p95, s[n // 2 + 1] AS p50 FROM ({SORTED})")
def pctl_floor(t):
    p95 = lambda n: F.least(F.floor(n * 0.95), n - 1)
    return kth(t("events"), "event_type", "value", {"p95": (0.95, p95), "p50": (0.5, lambda n: F.floor(n / 2))})


@query(f"SELECT event_type, n, s[round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p95 FROM ({SORTED})")
def pctl_nearest(t):
    return kth(t("events"), "event_type", "value", {"p95": (0.95, lambda n: F.bround(0.95 * (n - 1), 0).cast("long"))})


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def pctl_linear(t):
    at = lambda n: F.lit(0.99) * (n - 1)
    both = kth(t("events"), "event_type", "value", {"low": (0.99, lambda n: F.floor(at(n))), "high": (0.99, lambda n: F.ceil(at(n)))})
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    return both.select("event_type", F.round(F.col("low") + (F.col("high") - F.col("low")) * part, 6).alias("p99"))


sql_query("hourly_counters", f"SELECT {HOUR} AS hour, event_type AS metric, count(*) AS n FROM {{events}} GROUP BY 1, 2")
sql_query("low_csat_alerts", "SELECT event_id, user_id FROM {events} WHERE event_type = 'click' AND value <= 2")
sql_query(
    "sliding_latency",
    """
    SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean_100
    FROM {events}
    """,
)
sql_query(
    "ttl_expired",
    """
    SELECT event_id, SECONDS(ts, (SELECT max(ts)
        FROM {events})) > 86400 AS expired, greatest(0, 86400 - SECONDS(ts, (SELECT max(ts)
          FROM {events}))) AS remaining
    FROM {events}
    """,
)
sql_query("scaling_decision", f"SELECT hour, n, CASE WHEN n > 20 OR mean > 80 THEN 'up' WHEN n < 5 THEN 'down' ELSE 'stay' END AS decision FROM (SELECT {HOUR} AS hour, count(*) AS n, avg(value) AS mean FROM {{events}} GROUP BY 1)")
sql_query("workers_needed", f"SELECT hour, CAST(floor((n + n * 5) / CAST(50 AS DOUBLE)) AS BIGINT) + 1 AS workers FROM (SELECT {HOUR} AS hour, count(*) AS n FROM {{events}} GROUP BY 1)")


@query("""
WITH b AS (
  SELECT round_even(value / 100, 2) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS good FROM events GROUP BY 1
), c AS (
  SELECT a.bucket, sum(o.n) AS hits, sum(o.good) AS hit_good, (SELECT sum(good) FROM b) AS total FROM b a JOIN b o ON o.bucket >= a.bucket GROUP BY a.bucket
), f AS (
  SELECT bucket, CASE WHEN hit_good > 0 THEN 2 * (hit_good / hits) * (hit_good / total) / (hit_good / hits + hit_good / total) ELSE 0 END AS f1 FROM c
)
SELECT bucket AS recommended, round(f1, 9) AS f1, (SELECT sum(n)::BIGINT FROM b) AS n, NULL::VARCHAR AS note FROM f ORDER BY round(f1, 12) DESC, bucket DESC LIMIT 1
""")
def threshold_tuning(t):
    """The value of an event, in hundredths, as a similarity; a purchase as a right answer."""
    e = t("events").select((F.col("value") / 100).alias("similarity"), (F.col("event_type") == "purchase").alias("correct"))
    return tune_threshold(e, "similarity", "correct")


@query("""
WITH s AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error')::DOUBLE AS bad, date_sub('second', min(ts), max(ts))::DOUBLE AS age FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN age < 60 THEN 3600 ELSE greatest(30, least(86400, 3600 * least(2, 1 + n / age * 36) * greatest(0.25, 1 - bad / age * 1800))) END, 6) AS ttl FROM s
""")
def adaptive_ttl(t):
    """Events are accesses of a user's entry, errors invalidations; its age is the time between the first and the last."""
    s = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("age"))
    return s.select("user_id", F.round(desk.adaptive_ttl(F.col("n"), F.col("bad"), F.col("age")), 6).alias("ttl"))


@query("""
WITH d AS (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, avg(value) FILTER (event_type = 'view') * 600 AS first_ms, avg(value) FILTER (event_type = 'purchase') * 10 AS seconds,
  100.0::DOUBLE * count(*) FILTER (event_type IN ('view', 'click')) / count(*) AS automation, 100.0::DOUBLE * count(*) FILTER (event_type = 'signup') / count(*) AS escalation FROM events GROUP BY 1),
f AS (SELECT day, list(tool ORDER BY tool) AS failing FROM (
  SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, 'tool' || (user_id % 3) AS tool FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.1) GROUP BY day)
SELECT d.day, coalesce(first_ms < 30000, FALSE) AS first_response, automation >= 70 AS resolution_rate, escalation <= 15 AS escalation_rate, coalesce(seconds < 480, FALSE) AS handle_time,
  array_to_string(list_concat(list_filter([CASE WHEN NOT coalesce(first_ms < 30000, FALSE) THEN 'scale triage' END, CASE WHEN automation < 70 THEN 'review escalation reasons' END, CASE WHEN escalation > 15 THEN 'train for escalations' END], lambda x: x IS NOT NULL),
    list_transform(coalesce(failing, []), lambda x: 'review ' || x)), '; ') AS advice
FROM d LEFT JOIN f ON f.day = d.day
""")
def sla_report(t):
    """Days of events: views are first responses, purchases handled conversations, views and clicks automated ones, signups escalations; a user's calls are one of three tools'."""
    e = t("events").withColumn("day", F.date_trunc("day", "ts").cast("date").cast("string"))
    kind = F.col("event_type")
    tool = F.concat(F.lit("tool"), (F.col("user_id") % 3).cast("string"))
    failing = e.groupBy("day", tool.alias("tool")).agg((F.count_if(kind == "error") / F.count(F.lit(1))).alias("share")).where("share > 0.1").groupBy("day").agg(F.sort_array(F.collect_list("tool")).alias("failing"))
    share = lambda *names: 100 * F.count_if(kind.isin(*names)) / F.count(F.lit(1))
    mean = lambda name: F.avg(F.when(kind == name, F.col("value")))
    d = e.groupBy("day").agg((mean("view") * 600).alias("first_ms"), (mean("purchase") * 10).alias("seconds"), share("view", "click").alias("automation"), share("signup").alias("escalation")).join(failing, "day", "left")
    met = desk.service_level(*[F.col(c) for c in ("first_ms", "seconds", "automation", "escalation")])
    met = {k: F.coalesce(v, F.lit(False)) for k, v in met.items()}
    texts = desk.advice(met, F.coalesce("failing", F.array().cast("array<string>")))
    return d.select("day", *[v.alias(k) for k, v in met.items()], F.array_join(texts, "; ").alias("advice"))


@query("""
SELECT event_id, (props->>'$.k')::BIGINT AS k, '{"user":' || user_id || ',"props":' || '{"k":' || (props->>'$.k') || '},"tags":["' || event_type || '"]}' AS again,
  event_type AS tag FROM events
""")
def props_json(t):
    """Properties are read with a type, put into a record, written as JSON and read back."""
    typed = t("events").withColumn("props", F.from_json("props", "k bigint"))
    text = F.to_json(F.struct(F.col("user_id").alias("user"), "props", F.array("event_type").alias("tags")))
    out = typed.select("event_id", text.alias("again")).withColumn("back", F.from_json("again", "user bigint, props struct<k:bigint>, tags array<string>"))
    return out.select("event_id", F.col("back.props.k").alias("k"), "again", F.col("back.tags")[0].alias("tag"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 100")
def metrics_ring(t):
    """The last hundred values of each metric, as a ring buffer keeps them."""
    back = position(t("events").select("event_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), ["event_type"], [-F.col("at"), -F.col("event_id")], "back")
    return back.where("back <= 100").select("event_id")


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most
FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type
""")
def platform_report(t):
    e = t("events").where((F.col("ts") >= "2024-01-05 00:00:00") & (F.col("ts") < "2024-01-20 00:00:00"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))


def share(part, whole):
    """part / whole, 0 of nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS resolved, round(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / greatest(count(*), 1), 6) AS automation
FROM events WHERE ts >= (SELECT date_trunc('hour', max(ts)) FROM events)
""")
def realtime_stats(t):
    """The current hour is that of the newest event."""
    e = t("events")
    now = e.agg(F.date_trunc("hour", F.max("ts")).alias("now"))
    done = F.count_if(F.col("event_type") == "purchase")
    return e.join(F.broadcast(now), F.col("ts") >= F.col("now")).agg(F.count(F.lit(1)).alias("total"), done.alias("resolved"), F.round(100 * share(done, F.count(F.lit(1))), 6).alias("automation"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS hits, count(*) FILTER (event_type = 'view') AS misses,
  round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'view')) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) FILTER (event_type IN ('purchase', 'view')) END, 6) AS hit_rate
FROM events GROUP BY user_id
""")
def hit_rates(t):
    hits, misses = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return t("events").groupBy("user_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(share(hits, hits + misses), 6).alias("hit_rate"))


@query("""
SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS saved, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS incurred FROM events GROUP BY user_id
""")
def savings_report(t):
    total = lambda kind: F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)), 4)
    return t("events").groupBy("user_id").agg(total("purchase").alias("saved"), total("view").alias("incurred"))


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_lines(t):
    n = t("events").groupBy("event_type").count()
    return n.select(F.format_string('events_total{type="%s"} %d', "event_type", "count").alias("line"))


@query("""
WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM e WHERE bad)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM g GROUP BY user_id, run) GROUP BY user_id
""")
def failure_streaks(t):
    """The longest run of errors of each user who has one: errors with the same number of other events before them are one run."""
    e = t("events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    at = running(e, ["user_id"], ["ts", "event_id"], {"others": (~F.col("bad")).cast("long")})
    return at.where("bad").groupBy("user_id", "others").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""
SELECT user_id, date_sub('second', max(ts), (SELECT max(ts) FROM events)) AS silent FROM events GROUP BY user_id HAVING date_sub('second', max(ts), (SELECT max(ts) FROM events)) > 3600
""")
def stale_workers(t):
    """Users as workers, events as heartbeats; now is the newest one. Users' last ones are counted first, so events are read once."""
    last = written(t("events").groupBy("user_id").agg(F.max("ts").alias("ts")))
    now = last.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now)).select("user_id", F.expr("timestampdiff(SECOND, ts, now)").alias("silent")).where("silent > 3600")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1
""")
def idempotent_submit(t):
    """Of submissions with one key the first counts: an aggregate, so a key that most rows have is no task's burden."""
    return t("events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1
""")
def latest_checkpoint(t):
    return latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth % 10 = 0")
def checkpoint_every_n(t):
    return position(t("events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "nth").where("nth % 10 = 0").select("user_id", "event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) = (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY event_type")
def decisions_today(t):
    """Today is the day of the newest event. Events are counted by day first."""
    days = written(t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")))
    today = days.agg(F.max("day").alias("day"))
    return days.join(F.broadcast(today), "day", "left_semi").select("event_type", "n")


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.3 THEN 'fragmentation' WHEN max(value) > 500 THEN 'latency' ELSE 'none' END AS reason FROM events GROUP BY user_id
""")
def should_reindex(t):
    """Errors are a user's fragments, values latencies."""
    bad = F.avg((F.col("event_type") == "error").cast("double"))
    return t("events").groupBy("user_id").agg(F.when(bad > 0.3, "fragmentation").when(F.max("value") > 500, "latency").otherwise("none").alias("reason"))


@query("SELECT user_id, round(avg(value * 1000) FILTER (value > 0), 4) AS mean_ms, count(*) FILTER (value <= 1) AS idle FROM events GROUP BY user_id")
def scaling_metrics(t):
    v = F.col("value")
    return t("events").groupBy("user_id").agg(F.round(F.avg(F.when(v > 0, v * 1000)), 4).alias("mean_ms"), F.count_if(v <= 1).alias("idle"))


@query(f"""
SELECT user_id, round(greatest(0.0::DOUBLE, avg(n - before)), 6) AS rate FROM (
  SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY hour) AS before, row_number() OVER (PARTITION BY user_id ORDER BY hour DESC) AS back
  FROM (SELECT user_id, {HOUR} AS hour, count(*) AS n FROM events GROUP BY 1, 2)) WHERE back <= 10 GROUP BY user_id
""")
def incoming_rate(t):
    """The mean change from hour to hour over a user's last ten: the sum of the changes is the last count less the one before the first."""
    hours = t("events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    last = W.partitionBy("user_id").orderBy(F.desc("hour"))
    at = hours.withColumn("back", F.row_number().over(last)).where("back <= 11")
    newest, oldest, n = F.max_by("n", "hour"), F.min_by("n", "hour"), F.count(F.lit(1))
    return at.groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), (newest - oldest) / F.nullif(n - 1, F.lit(0))), 6).alias("rate"))
