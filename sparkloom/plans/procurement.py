"""Purchase requests are orders, their items lineitems, vendors suppliers, cost centres market segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import policies as P
from sparkloom.operators.rules import Rule, delegate, evaluate
from sparkloom.operators.routing import best_members
from sparkloom.operators.scan import position, running
from sparkloom.operators.sets import duplicate_requests as duplicates
from sparkloom.plans._registry import query, sql_query

LEVEL = "CASE WHEN {0} > 1000000 THEN 'board' WHEN {0} > 100000 THEN 'executive' WHEN {0} > 25000 THEN 'vp' WHEN {0} > 5000 THEN 'director' WHEN {0} > 500 THEN 'manager' ELSE 'auto' END"
RANK = "CASE {0} WHEN 'auto' THEN 0 WHEN 'manager' THEN 1 WHEN 'director' THEN 2 WHEN 'vp' THEN 3 WHEN 'executive' THEN 4 ELSE 5 END"
ASOF = "(SELECT max(o_orderdate) FROM {orders})"

sql_query("approval_level", f"SELECT o_orderkey, {LEVEL.format('o_totalprice')} AS level FROM {{orders}}")
@query("""
SELECT k, score, CASE WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM (
  SELECT o_orderkey AS k, least(100, CASE WHEN o_totalprice > 300000 THEN 30 WHEN o_totalprice > 100000 THEN 15 ELSE 0 END
    + 25 * ((count(l_orderkey) = 0)::BIGINT + count(*) FILTER (l_discount > 0.09)) + 20 * count(*) FILTER (s_acctbal < 0)
    + CASE WHEN o_orderpriority = '1-URGENT' THEN 10 ELSE 0 END) AS score
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY o_orderkey, o_totalprice, o_orderpriority)
""")
def risk_score(t):
    """Issues of high severity: a request without items, and each discount above 9 %."""
    items = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    items = items.groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") > 0.09).alias("issues"), F.count_if(F.col("s_acctbal") < 0).alias("risky"))
    o = t("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    issues = F.coalesce("issues", F.lit(1).cast("long"))
    policy = P.RiskPolicy(high_amount=300_000.0, some_amount=100_000.0)
    score = P.risk_score(F.col("o_totalprice"), issues, F.coalesce("risky", F.lit(0).cast("long")), F.col("o_orderpriority") == "1-URGENT", policy)
    return o.select(F.col("o_orderkey").alias("k"), score.alias("score"), P.risk_level(score, policy).alias("level"))
APPROVERS = "(VALUES (1, 'manager', 5000), (2, 'director', 25000), (3, 'vp', 100000), (4, 'vp', 60000), (5, 'executive', 0)) AS a(reg, lvl, most)"
sql_query("approver_candidates", f"SELECT o_orderkey, count(*) AS candidates, min(reg) AS first FROM (SELECT o_orderkey, o_totalprice, {LEVEL.format('o_totalprice')} AS level FROM {{orders}}) o JOIN {APPROVERS} ON {RANK.format('lvl')} >= {RANK.format('level')} AND (most = 0 OR o_totalprice <= most) GROUP BY o_orderkey")
sql_query("approval_routing", f"SELECT o_orderkey, level, reg FROM (SELECT o_orderkey, level, reg, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN lvl = level THEN 0 ELSE 1 END, reg) AS nth FROM (SELECT o_orderkey, o_totalprice, {LEVEL.format('o_totalprice')} AS level FROM {{orders}}) o JOIN {APPROVERS} ON {RANK.format('lvl')} >= {RANK.format('level')} AND (most = 0 OR o_totalprice <= most)) WHERE nth = 1")
@query("""
WITH o AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 5 + 1)::INT AS approver FROM orders),
d(pos, approver, delegate, until) AS (VALUES (0, 1, 99, NULL), (1, 1, 4, TIMESTAMP '1996-01-01'), (2, 1, 2, NULL), (3, 3, 5, TIMESTAMP '1999-01-01'), (4, 3, 1, TIMESTAMP '1997-01-01'))
SELECT o_orderkey, coalesce((SELECT min_by(delegate, pos) FROM d WHERE d.approver = o.approver AND delegate BETWEEN 1 AND 5 AND (until IS NULL OR until >= o_orderdate)), approver)::INT AS approver FROM o
""")
def delegations(t):
    """The first delegate of approver 1 isn't registered, two rules of one approver overlap, and one ends."""
    spark = t("orders").sparkSession
    rows = [(0, 1, 99, None), (1, 1, 4, "1996-01-01"), (2, 1, 2, None), (3, 3, 5, "1999-01-01"), (4, 3, 1, "1997-01-01")]
    rules = spark.createDataFrame(rows, "pos int, approver int, delegate int, until string").withColumn("until", F.col("until").cast("timestamp_ntz"))
    chain = t("orders").select("o_orderkey", F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("approver"))
    return delegate(chain, rules, spark.range(1, 6).select(F.col("id").cast("int").alias("id"))).select("o_orderkey", F.col("acting").alias("approver"))
sql_query(
    "order_status_desc",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Order is open' WHEN 'F' THEN 'Order was filled' ELSE o_orderstatus END AS description
    FROM {orders}
    """,
)
sql_query("mask_payment", "SELECT c_custkey, CASE WHEN c_name IS NOT NULL AND c_name <> '' THEN concat('****', right(c_name, 4)) ELSE c_mktsegment END AS card FROM {customer}")
sql_query("account_balance", "SELECT c_custkey, 10000 - c_acctbal AS credit_available, CASE WHEN c_acctbal <= 0 THEN 'current' ELSE 'due' END AS payment_status FROM {customer}")
sql_query(
    "purchase_orders",
    """
    SELECT l_orderkey, concat('PO-', CAST(l_orderkey AS STRING)) AS po, listagg(concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING)), ',') WITHIN GROUP ( ORDER BY l_linenumber, l_partkey) AS items
    FROM {lineitem}
    GROUP BY l_orderkey
    """,
    """
    SELECT l_orderkey, concat('PO-', l_orderkey::VARCHAR) AS po, string_agg(concat(l_linenumber::VARCHAR, ':', l_partkey::VARCHAR), ','
      ORDER BY l_linenumber, l_partkey) AS items
    FROM lineitem
    GROUP BY l_orderkey
    """,
)
RULES = [Rule("positive", "o_totalprice > 0"), Rule("known_status", "o_orderstatus IN ('O', 'F', 'P')"), Rule("below_cap", "o_totalprice < 400000", "medium"), Rule("urgent_small", "o_orderpriority <> '1-URGENT' OR o_totalprice < 250000", "low")]


@query("""
SELECT o_orderkey, u.r.rule AS rule, u.r.severity AS severity, u.r.holds AS holds FROM orders, unnest([
  {'rule': 'positive', 'severity': 'high', 'holds': o_totalprice > 0}, {'rule': 'known_status', 'severity': 'high', 'holds': o_orderstatus IN ('O', 'F', 'P')},
  {'rule': 'below_cap', 'severity': 'medium', 'holds': o_totalprice < 400000}, {'rule': 'urgent_small', 'severity': 'low', 'holds': NOT (o_orderpriority = '1-URGENT' AND o_totalprice >= 250000)}]) AS u(r)
""")
def rule_engine(t):
    return evaluate(t("orders"), RULES, ["o_orderkey"])
sql_query("diagnostic_findings", "SELECT l_orderkey, count(CASE WHEN l_tax > CAST(0.07 AS DOUBLE) THEN 1 END) AS critical, count(*) AS findings FROM {lineitem} GROUP BY l_orderkey")


@query("""
SELECT o_orderkey, c_mktsegment, round(sum(o_totalprice) OVER (PARTITION BY c_mktsegment, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS spent
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def budget_running(t):
    o = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "c_mktsegment", "o_orderdate", "o_totalprice", F.date_trunc("month", "o_orderdate").alias("month"))
    return running(o, ["c_mktsegment", "month"], ["o_orderdate", "o_orderkey"], {"spent": F.col("o_totalprice")}).select("o_orderkey", "c_mktsegment", F.round("spent", 2).alias("spent"))


URGENCY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {URGENCY}, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def pending_approvals(t):
    waiting = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", F.expr(URGENCY).alias("urgency"))
    return position(waiting, [], ["urgency", "o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def priority_order(t):
    return position(t("orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("""
WITH parts AS (SELECT s_suppkey, s_name, s_acctbal, list_distinct(list(split_part(p_type, ' ', 1))) AS categories
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
asked AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS category FROM part),
known AS (SELECT category, v.*, row_number() OVER (PARTITION BY category ORDER BY s_suppkey) AS n FROM asked JOIN parts v ON list_contains(v.categories, category))
SELECT a.category, s_suppkey, rating FROM asked a LEFT JOIN (
  SELECT category, s_suppkey, floor(s_acctbal / 1000) AS rating, row_number() OVER (PARTITION BY category ORDER BY floor(s_acctbal / 1000) DESC, s_suppkey) AS nth
  FROM known WHERE n <= 1000 AND s_acctbal > 0 AND s_suppkey % 3 <> 0) b ON b.category = a.category AND nth = 1
""")
def best_vendor(t):
    """Suppliers' categories are the kinds of parts that they deliver, their rating is the balance in thousands; they are preferred if it is over 0, and two of three are certified."""
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    parts = t("part").select("p_partkey", kind.alias("category"))
    sold = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("category").alias("categories"))
    vendors = t("supplier").join(sold, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "categories", "s_acctbal", F.floor(F.col("s_acctbal") / 1000).cast("double").alias("rating"))
    eligible = (F.col("s_acctbal") > 0) & (F.col("s_suppkey") % 3 != 0)
    return best_members(parts, vendors, "category", "categories", eligible, F.col("rating"), "s_suppkey").select("category", "s_suppkey", "rating")


@query("""
WITH lines AS (
  SELECT l_orderkey AS id, l_partkey, l_suppkey FROM lineitem
  UNION ALL SELECT -l_orderkey, l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE l_suppkey END FROM lineitem WHERE l_orderkey % 4 = 0
  UNION ALL SELECT -l_orderkey, l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE l_suppkey END FROM lineitem WHERE l_orderkey % 8 = 0
), r AS (
  SELECT o_orderkey AS id, o_custkey, round(o_totalprice * 10000)::BIGINT AS total FROM orders
  UNION ALL SELECT -o_orderkey, o_custkey, round((o_totalprice + CASE o_orderkey % 12 WHEN 0 THEN 0.02 WHEN 4 THEN 0.0099 ELSE 0 END) * 10000)::BIGINT FROM orders WHERE o_orderkey % 4 = 0
), s AS (
  SELECT r.*, items FROM r LEFT JOIN (SELECT id, list_sort(list_distinct(list((l_partkey, l_suppkey)))) AS items FROM lines GROUP BY id) USING (id)
)
SELECT a.id, min(b.id) AS duplicate_of FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.items IS NOT DISTINCT FROM b.items AND a.id <> b.id AND abs(a.total - b.total) < 100 GROUP BY a.id
""")
def duplicate_requests(t):
    """Every fourth order is sent again under its negative number, half of these with each line twice; some with other suppliers, some with a total that differs by 0.0099, some by 0.02."""
    again = t("orders").where("o_orderkey % 4 = 0")
    more = F.when(F.col("o_orderkey") % 12 == 0, 0.02).when(F.col("o_orderkey") % 12 == 4, 0.0099).otherwise(0.0)
    request = lambda df, sign, total: df.select((sign * F.col("o_orderkey")).alias("id"), F.col("o_custkey").alias("requester"), total.alias("total"), (sign * F.col("o_orderkey")).alias("place"))
    requests = request(t("orders"), 1, F.col("o_totalprice")).unionByName(request(again, -1, F.col("o_totalprice") + more))
    items = t("lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey")
    other = F.when(F.col("id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey"))
    copies = items.where("id % 4 = 0").unionByName(items.where("id % 8 = 0")).select((-F.col("id")).alias("id"), "l_partkey", other.alias("l_suppkey"))
    return duplicates(requests, items.unionByName(copies), ["l_partkey", "l_suppkey"])


@query("""
WITH paid AS (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS refunded FROM lineitem GROUP BY l_orderkey)
SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'order not found' WHEN o_totalprice * 0.4::DOUBLE > o_totalprice - coalesce(refunded, 0) THEN 'amount exceeds balance'
  WHEN c_mktsegment = 'MACHINERY' THEN 'idempotency key required' END AS error
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN paid ON l_orderkey = o_orderkey
""")
def refund_check(t):
    """Customers ask for 40 % of each order back. The key of a request is made of its customer and order; machinery customers send none."""
    paid = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("refunded"))
    r = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").join(paid, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.when(F.col("c_mktsegment") != "MACHINERY", F.sha2(F.concat_ws(":", "c_custkey", "o_orderkey"), 256))
    left = F.col("o_totalprice") - F.coalesce("refunded", F.lit(0.0))
    error = F.when(F.col("o_orderkey").isNull(), "order not found").when(F.col("o_totalprice") * 0.4 > left, "amount exceeds balance").when(F.coalesce(key, F.lit("")) == "", "idempotency key required")
    return r.select("c_custkey", "o_orderkey", error.alias("error"))


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total, count(*) AS n_items, count(*) FILTER (l_discount > 0) AS discounted FROM lineitem GROUP BY l_orderkey
""")
def request_totals(t):
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(total, 4).alias("total"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("l_discount") > 0).alias("discounted"))


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus
""")
def procurement_summary(t):
    x = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 2).alias("total"), F.round(F.avg(x), 4).alias("mean"), F.count_if(x > 100_000).alias("large"))


def priced(t):
    """Lines with their part's contract price, null without one."""
    return t("lineitem").join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN p_retailprice < l_extendedprice / l_quantity THEN p_retailprice END AS contract_price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def contract_join(t):
    better = F.col("p_retailprice") < F.col("l_extendedprice") / F.col("l_quantity")
    return priced(t).select("l_orderkey", "l_linenumber", F.when(better, F.col("p_retailprice")).alias("contract_price"))


@query("""
SELECT l_orderkey, round(sum(greatest(0.0::DOUBLE, l_extendedprice - p_retailprice * l_quantity)), 2) AS savings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
""")
def contract_savings(t):
    saved = F.greatest(F.lit(0.0), F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity"))
    return priced(t).where("p_partkey IS NOT NULL").groupBy("l_orderkey").agg(F.round(F.sum(saved), 2).alias("savings"))


@query("""
SELECT o_orderkey, o_totalprice <= 50000 AND bool_and(s_suppkey IS NULL OR s_acctbal >= 0) AS automatic
FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey, o_totalprice
""")
def auto_approval(t):
    """Small requests of which no vendor is in debt. Lines meet vendors first and are summed up by order before orders are met."""
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    fine = lines.groupBy("l_orderkey").agg(F.bool_and(F.col("s_suppkey").isNull() | (F.col("s_acctbal") >= 0)).alias("fine"))
    return t("orders").join(fine, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", ((F.col("o_totalprice") <= 50_000) & F.col("fine")).alias("automatic"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice <= 0 THEN 'total must be positive' END, CASE WHEN n IS NULL THEN 'no items' END, CASE WHEN worst > 45 THEN 'quantity is large' END], lambda x: x IS NOT NULL), '; ') AS messages
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS worst FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def intake_validation(t):
    items = t("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("worst"))
    o = t("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    faults = [F.when(F.col("o_totalprice") <= 0, "total must be positive"), F.when(F.col("l_orderkey").isNull(), "no items"), F.when(F.col("worst") > 45, "quantity is large")]
    return o.select("o_orderkey", F.concat_ws("; ", *faults).alias("messages"))


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown user' WHEN c_mktsegment = 'MACHINERY' THEN 'no permission' WHEN o_totalprice > 300000 THEN 'over spending limit' ELSE 'ok' END AS reason
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def authz_check(t):
    o = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = F.when(F.col("c_custkey").isNull(), "unknown user").when(F.col("c_mktsegment") == "MACHINERY", "no permission").when(F.col("o_totalprice") > 300_000, "over spending limit")
    return o.select("o_orderkey", reason.otherwise("ok").alias("reason"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
def top_requesters(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)


@query("SELECT p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def top_categories(t):
    """Orders of a type count once: (type, order) is made distinct first, so no task holds the orders of a type."""
    kinds = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return kinds.select("p_type", "l_orderkey").distinct().groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(5)


@query("""
SELECT l_orderkey, 4 * greatest(1, count(*)) AS hours, min(l_linenumber) FILTER (l_linestatus = 'O') AS first_pending, NOT bool_or(l_linestatus = 'O') AS complete FROM lineitem GROUP BY l_orderkey
""")
def approval_state(t):
    """Lines are steps of four hours each; open ones are pending."""
    pending = F.col("l_linestatus") == "O"
    return t("lineitem").groupBy("l_orderkey").agg((4 * F.count(F.lit(1))).alias("hours"), F.min(F.when(pending, F.col("l_linenumber"))).alias("first_pending"), (F.count_if(pending) == 0).alias("complete"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND date_sub('second', o_orderdate, (SELECT max(o_orderdate) FROM orders)) <= 30 * 86400 AS returnable FROM orders")
def return_window(t):
    """Today is the day of the newest order."""
    now = t("orders").agg(F.max("o_orderdate").alias("now"))
    recent = F.expr("timestampdiff(SECOND, o_orderdate, now)") <= 30 * 86_400
    return t("orders").join(F.broadcast(now)).select("o_orderkey", ((F.col("o_orderstatus") == "F") & recent).alias("returnable"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 'CRITICAL' WHEN coalesce(sum(o_totalprice), 0) > 3000000 OR c_acctbal > 8000 OR count(*) FILTER (o_orderstatus = 'O') > 10 THEN 'HIGH' ELSE 'NORMAL' END AS priority
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal
""")
def customer_priority(t):
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    c = t("customer").join(spent, F.col("o_custkey") == F.col("c_custkey"), "left")
    high = (F.coalesce("spent", F.lit(0.0)) > 3_000_000) | (F.col("c_acctbal") > 8000) | (F.coalesce("open", F.lit(0)) > 10)
    critical = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)
    return c.select("c_custkey", F.when(critical, "CRITICAL").when(high, "HIGH").otherwise("NORMAL").alias("priority"))
