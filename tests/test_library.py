"""Operators and functions with literal fixtures, and with plain Python where SQL can't say them."""

import datetime
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import json as J
from sparkloom.functions import policies as P
from sparkloom.functions.embedding import hash_embed
from sparkloom.functions.numbers import decimals_to_numbers, floats_to_decimals
from sparkloom.operators import chunking as C
from sparkloom.operators import merge as M
from sparkloom.operators import retrieval as R
from sparkloom.operators import rules as RU
from sparkloom.operators import sequential as S
from sparkloom.operators.graph import cascade
from sparkloom.operators.percentiles import kth
from sparkloom.operators.rules import Rule, delegate, evaluate, tune_threshold, within_limit
from sparkloom.plans.procurement import LEVEL
from sparkloom.sources import task_state
from tests.conftest import DATA

TEXTS = [None, "", "   ", "nospaces" * 400, "short", "x" * 1000, "One. Two! Three? four. Five.\n\n\nSix\n\nseven. " * 60, "A very long sentence " * 200 + ". Next one. " * 30, "Ein Satz. Über. Und noch einer. Ja."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk string").repartition(3)


def test_approval_levels(spark):
    want = [(100, "auto"), (499, "auto"), (500, "auto"), (501, "manager"), (3000, "manager"), (5000, "manager"), (5001, "director"), (15000, "director"), (25000, "director"), (25001, "vp"), (75000, "vp"), (100000, "vp"), (100001, "executive"), (1_000_000, "executive"), (1_000_001, "board")]
    got = spark.createDataFrame([(float(a),) for a, _ in want], "amount double").selectExpr("amount", f"{LEVEL.format('amount')} AS level").collect()
    assert {(r.amount, r.level) for r in got} == set(want)


def sentences(text, pattern=C.SENTENCE_END):
    return [s.strip() for s in re.split(pattern, text or "") if s.strip()]


@pytest.mark.parametrize("size, overlap", [(1000, 200), (10, 0), (50, 49)])
def test_fixed_chunks(docs, size, overlap):
    want = []
    for i, t in enumerate(TEXTS):
        at, n = 0, 0
        while at < len(t or ""):
            end, part = at + size, t[at : at + size]
            if end < len(t) and part.rfind(" ") > 0.8 * size:
                end = at + part.rfind(" ")
                part = t[at:end]
            want.append((i, n, at, end, part.strip()))
            at, n = max(at + 1, end - overlap), n + 1
    assert sorted(map(tuple, C.fixed_chunks(docs, size, overlap).collect())) == sorted(want)
    assert C.fixed_chunks(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        C.fixed_chunks(docs, 10, 10)


def packed(parts, most, overlap):
    out, a, size = [], 0, 0
    for i, s in enumerate(parts):
        if size + len(s) > most and i > a:
            out.append((a, i))
            a = max(a, i - overlap)
            size = sum(map(len, parts[a:i]))
        size += len(s)
    return [*out, (a, len(parts))] if parts else []


@pytest.mark.parametrize("most, overlap", [(1500, 1), (40, 0), (40, 3)])
def test_sentence_chunks(docs, most, overlap):
    want = []
    for i, t in enumerate(TEXTS):
        parts = sentences(t)
        want += [(i, n, a, b - a, " ".join(parts[a:b])) for n, (a, b) in enumerate(packed(parts, most, overlap))]
    assert sorted(map(tuple, C.sentence_chunks(docs, most, overlap).collect())) == sorted(want)
    assert C.sentence_chunks(docs.where("false")).count() == 0


def test_hierarchical_chunks(docs):
    got = C.hierarchical_chunks(docs, 300, 50, 80)
    rows = {r.chunk_id: r for r in got.collect()}
    for r in C.with_children(got).collect():
        parts = sentences(r.content)
        children = [rows[c] for c in r.child_ids]
        assert [c.content for c in children] == [" ".join(parts[a:b]) for a, b in packed(parts, 80, 1)]
        assert all(c.parent_id == r.chunk_id and c.level == 1 for c in children)
    top = C.fixed_chunks(docs, 300, 50).count()
    assert sum(r.level == 0 for r in rows.values()) == top and len(rows) == got.count()


def embedded(text, dim=64):
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h >> 31 else -1
    return v / (np.linalg.norm(v) or 1.0)


def test_hash_embed(docs):
    got = hash_embed(docs).collect()
    assert len(got) == len(TEXTS) and all(r.chunk == "kept" and np.allclose(r.embedding, embedded(r.text)) for r in got)


def test_semantic_chunks(spark, docs):
    rows = [(i, s, [embedded(x).tolist() for x in s]) for i, s in ((i, sentences(t, C.ANY_SENTENCE_END)) for i, t in enumerate(TEXTS))] + [(99, ["a", "b"], [[0.0] * 64] * 2), (100, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, sentences array<string>, vectors array<array<double>>")
    want = []
    for i, s, vectors in rows:
        groups = []
        for x, v in zip(s or [], map(np.array, vectors or [])):
            if groups:
                own, mean, n = groups[-1]
                norm = np.linalg.norm(mean) * np.linalg.norm(v)
                alike = mean @ v / norm if norm > 1e-15 else 0.0
                if not ((alike < 0.3 and sum(map(len, own)) >= 20) or sum(map(len, own)) + len(x) > 200):
                    groups[-1] = [own + [x], (mean * n + v) / (n + 1), n + 1]
                    continue
            groups.append([[x], v, 1])
        want += [(i, k, " ".join(g[0])) for k, g in enumerate(groups)]
    got = C.semantic_chunks(df, 0.3, 20, 200).select("doc_id", "chunk", "content").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > len(rows)


def test_admission(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", datetime.datetime(2024, 1, 30) + datetime.timedelta(hours=rng.randrange(200)), i, float(rng.randrange(1, 60)) if i % 50 else None) for i in range(400)]
    got = {r.id: (r.admitted, r.spent_day, r.spent_month) for r in S.admit(spark.createDataFrame(rows, "cost_center string, at timestamp_ntz, id long, amount double").repartition(5), 100.0, 400.0).collect()}
    day, month = {}, {}
    for c, at, i, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        d, m = (c, at.date()), (c, at.year, at.month)
        fits = x is not None and day.get(d, 0.0) + x <= 100 and month.get(m, 0.0) + x <= 400
        if fits:
            day[d], month[m] = day.get(d, 0.0) + x, month.get(m, 0.0) + x
        assert got[i] == (fits, day.get(d, 0.0), month.get(m, 0.0)), i
    assert {g[0] for g in got.values()} == {True, False}


def test_life_cycle(spark):
    names = ["claim", "fail", "claim", "fail", "complete", "claim", "pause", "resume", "fail", "claim"]
    rows = [("a", float(i), i, n) for i, n in enumerate(names)] + [("b", float(i), i, n) for i, n in enumerate(["complete", "claim", "return", "claim", "complete", "fail"])]
    got = {(r.task_id, r.id): (r.status, r.attempt, r.accepted) for r in S.life_cycle(spark.createDataFrame(rows, "task_id string, at double, id int, event string")).collect()}
    assert [got["a", i] for i in range(10)] == [("running", 1, True), ("retrying", 1, True), ("running", 2, True), ("retrying", 2, True), ("retrying", 2, False), ("running", 3, True), ("paused", 3, True), ("running", 3, True), ("failed", 3, True), ("failed", 3, False)]
    assert [got["b", i] for i in range(6)] == [("pending", 0, False), ("running", 1, True), ("pending", 0, True), ("running", 1, True), ("completed", 1, True), ("completed", 1, False)]


def test_autoscale_and_breaker(spark):
    rows = [("p", 0.0, 80, 10.0, 0), ("p", 30.0, 80, 10.0, 0), ("p", 60.0, 80, 10.0, 0), ("p", 400.0, 0, 10.0, 3), ("p", 500.0, 0, 10.0, 3), ("p", 700.0, 0, 10.0, 9)]
    got = S.autoscale(spark.createDataFrame(rows, "pool string, at double, depth int, latency_ms double, idle int")).orderBy("at").collect()
    assert [(r.change, r.workers) for r in got] == [(5, 7), (0, 7), (1, 8), (-2, 6), (0, 6), (-2, 4)]
    calls = [("x", float(i * 10), i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1, 0, 0])]
    got = S.circuit_breaker(spark.createDataFrame(calls, "provider string, at double, id int, failed int"), 3, 25.0).orderBy("at").collect()
    assert [r.allowed for r in got] == [True] * 6 + [False, False, True, True] and [r.failures for r in got] == [1, 2, 0, 1, 2, 3, 3, 3, 0, 0]
    items = [("t", float(i * 10), i, 100.0 if i < 6 else 1.0) for i in range(12)]
    got = S.checkpoints(spark.createDataFrame(items, "task_id string, at double, id int, cost double"), 10.0, 50.0, 50.0, window=2).orderBy("at").collect()
    assert [r.id for r in got if r.checkpoint] == [0, 2, 4, 6, 10]


def test_semantic_cache_replay(spark):
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0], "a2": [0.99, 0.14], "a3": [0.9, 0.436]}
    rows = [("s", float(i), i, v[n]) for i, n in enumerate(["a", "b", "a2", "a3", "a", "b"])] + [("s", 100.0, 6, v["a"]), ("s", 101.0, 7, None)]
    df = spark.createDataFrame(rows, "shard string, at double, id int, vector array<double>")
    got = S.replay_semantic_cache(df, S.CacheRules(threshold=0.95, ttl=50.0)).orderBy("id").collect()
    assert [(r.hit, r.matched) for r in got] == [(False, None), (False, 0), (True, 0), (False, 0), (True, 0), (True, 1), (False, None), (False, None)]
    assert [r.near_miss for r in got] == [False, False, False, True, False, False, False, False]
    small = S.replay_semantic_cache(df, S.CacheRules(threshold=0.999, same=0.9999, ttl=1e9, entries=2)).orderBy("id").collect()
    assert [r.hit for r in small] == [False] * 6 + [True, False]


def test_clocks(spark):
    cases = [({"a": 1}, {"a": 1}, "equal"), ({"a": 2, "b": 1}, {"a": 1}, "a"), ({}, {"a": 1}, "b"), ({"a": 2}, {"b": 1}, "concurrent"), (None, {}, "equal"), ({"a": 1, "b": 2}, {"a": 2, "b": 2}, "b"), ({"a": 0}, {}, "equal")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a map<string,bigint>, b map<string,bigint>")
    assert [r[0] for r in df.orderBy("i").select(M.clock_order(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]
    pair = spark.createDataFrame([({"x": 1.0, "_m": 5.0, "only_a": 0.0}, {"x": 2.0, "_m": 0.0, "only_b": 3.0}, {"a": 2}, {"b": 3, "a": 1})], "state_a map<string,double>, state_b map<string,double>, clock_a map<string,bigint>, clock_b map<string,bigint>")
    r = M.merge_states(pair).first()
    assert r.conflict and r.state == {"x": 3.0, "_m": 5.0, "only_a": 0.0, "only_b": 3.0} and r.clock == {"a": 2, "b": 3}
    assert spark.range(1).select(M.union_lists(F.array(F.lit(3), F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(1)))).first()[0] == [3, 1, 2]


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    changes = spark.createDataFrame([(1, "upsert", 1, "x"), (1, "upsert", 2, "y"), (2, "delete", 1, None), (4, "delete", 1, None), (5, "upsert", 1, None), (6, "upsert", 1, "z"), (6, "delete", 2, None)], "k int, op string, seq int, v string")
    assert sorted(map(tuple, M.apply_changes(base, changes, "k").collect())) == [(1, "y"), (3, None), (5, None)]
    assert M.apply_changes(base, changes.where("false"), "k").count() == 3 and M.apply_changes(base.where("false"), changes, "k").count() == 2


def test_json_repair(spark):
    cases = ['{"messages": [{"role": "user", "content": "Hello', '{"content": "Test \\ud800 message"}', '{"id": "abc", "id": "def", "content": "text"}', '{"a": "x', '{"a": [1, 2', '{"p": "\\ud83d\\ude00"} \n', '{"a": 1']
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(J.repair(F.col("t"))).collect()]
    assert got[0] == cases[0] + '"]}}' and got[1] == '{"content": "Test  message"}' and got[2] == cases[2]
    assert got[3:] == ['{"a": "x"}', '{"a": [1, 2]}', cases[5], '{"a": 1}']
    assert [r[0] for r in df.select(J.json_valid(J.repair(F.col("t")))).collect()][3:] == [True] * 4
    odd = [('{"a": "\\uDC00x\\ud83d\\ude00y\\uD83D\\uD83D\\uDE00"}', '{"a": "x\\ud83d\\ude00y\\uD83D\\uDE00"}'), (None, None)]
    assert [r[0] for r in spark.createDataFrame(odd, "t string, want string").select(J.repair(F.col("t"))).collect()] == [w for _, w in odd]


def test_params(spark):
    params = [J.Param("a", "integer", True), J.Param("b", "string", choices=("x", "y")), J.Param("c", "number"), J.Param("d", "array"), J.Param("e", "object"), J.Param("f", "boolean"), J.Param("g", "date")]
    cases = {'{"a": 1}': None, "{}": "missing a", '{"a": true}': "a is no integer", '{"a": 1, "b": "z"}': "b is none of its choices", '{"a": 1, "b": 2}': "b is no string", '{"a": 1, "c": 1.5, "d": [], "e": {}, "f": false, "g": 1}': None, '{"a": 1, "c": "1"}': "c is no number", '{"a": 1, "d": {}}': "d is no array", '{"a": 1, "f": 0}': "f is no boolean", '{"a": null}': "a is no integer", "no json": "missing a"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.e for r in df.select("t", J.first_error(F.col("t"), params).alias("e")).collect()} == cases


def test_numbers(spark):
    df = spark.createDataFrame([(1, 0.1, [{"x": 2.0}], {"k": 1.25}), (2, None, None, None), (3, float("nan"), [], {})], "i int, d double, l array<struct<x:double>>, m map<string,double>")
    out = floats_to_decimals(df)
    assert "double" not in out.schema.simpleString()
    back = {r.i: r for r in decimals_to_numbers(out).collect()}
    assert (back[1].d.whole, back[1].d.real) == (None, 0.1) and back[1].l[0].x.whole == 2 and back[1].m["k"].real == 1.25
    assert back[2].d is None and back[2].l is None and back[3].d is None and back[3].l == []


def test_threshold(spark):
    def tuned(rows):
        return tune_threshold(spark.createDataFrame(rows, "s double, c boolean"), "s", "c").first()

    rng = random.Random(8)
    rows = [(rng.randrange(70, 100) / 100, rng.random() < 0.5) for _ in range(100)]
    best = max(((2 * sum(c for s, c in rows if s >= t) / (sum(s >= t for s, _ in rows) + sum(c for _, c in rows)), t) for t in {s for s, _ in rows}))
    got = tuned(rows)
    assert (round(best[0], 9), best[1], 100) == (got.f1, got.recommended, got.n)
    tie = tuned([(0.9, True)] * 50 + [(0.8, True)] * 0 + [(0.7, False)] * 50)
    assert tie.recommended == 0.9 and tie.f1 == 1.0
    assert tuned(rows[:99]).note and tuned([(0.5, False)] * 100).recommended == 1.0 and tuned(rows[:0]).n == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, x int")
    got = {(r.k, r.rule): (r.severity, r.holds) for r in evaluate(df, [Rule("p", "x > 0"), Rule("q", F.col("k") > 1, "low")], ["k"]).collect()}
    assert got == {(1, "p"): ("high", True), (2, "p"): ("high", False), (1, "q"): ("low", False), (2, "q"): ("low", True)}
    chain = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 5), (4, "c", 5)], "k int, approver string, at int")
    rules = spark.createDataFrame([(2, "a", "y", None), (1, "a", "x", 10), (0, "a", "gone", None), (0, "b", "x", 1)], "pos int, approver string, delegate string, until int")
    acting = {r.k: r.acting for r in delegate(chain, rules, spark.createDataFrame([("x",), ("y",)], "id string")).collect()}
    assert acting == {1: "x", 2: "y", 3: "b", 4: "c"}
    with pytest.raises(RuntimeError):
        within_limit(df, 1)
    assert within_limit(df, 2).count() == 2


def test_policies(spark):
    keys = [("emb:1", None, 2_592_000), ("llm:1", 0.0, 86_400), ("llm:2", 0.5, 0), ("llm:3", None, 86_400), ("tool:x", 1.0, 600), ("other", None, 3600)]
    df = spark.createDataFrame(keys, "k string, t double, want int")
    assert all(r.want == r.got for r in df.select("want", P.ttl(F.col("k"), F.col("t")).alias("got")).collect())
    assert [r[0] for r in spark.createDataFrame([("a:b:c",), ("x",), (":y",)], "k string").select(P.namespace(F.col("k"))).collect()] == ["a", "default", ""]
    texts = ["4111 1111", "4111111111111111 is mine", "1234567890123456 order", "I promise, definitely", "Never fails. ALWAYS."]
    cost = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(P.compliance_cost(F.col("t"))).collect()
    assert [r[0] for r in cost] == [0, 50, 0, 20, 20]
    score = lambda *x: spark.range(1).select(P.risk_score(*[F.lit(v) for v in x])).first()[0]
    assert [score(100_001.0, 0, 0, False), score(100_000.0, 1, 2, True), score(25_000.0, 0, 0, False), score(1e6, 3, 0, False)] == [30, 90, 0, 100]


def test_cascade(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 2), (9, 9)]
    got = {(r.root, r.node) for r in cascade(spark.createDataFrame(edges, "key int, dependent int"), spark.createDataFrame([(1,), (4,), (9,), (7,)], "key int")).collect()}
    assert got == {(1, n) for n in (1, 2, 3, 4, 5)} | {(4, n) for n in (4, 2, 3)} | {(9, 9), (7, 7)}


@pytest.mark.parametrize("n", [1, 2, 10, 100, 5000])
def test_percentiles(spark, n):
    rng = random.Random(n)
    rows = [("g", rng.choice([rng.random(), 0.5])) for _ in range(n)] + [("h", 1.0), ("h", None)]
    wanted = {"floor": (0.95, lambda m: F.least(F.floor(m * 0.95), m - 1)), "half": (0.5, lambda m: F.floor(m / 2)), "near": (0.95, lambda m: F.bround(0.95 * (m - 1), 0).cast("long"))}
    got = {r.g: r for r in kth(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", wanted).collect()}
    s = sorted(v for g, v in rows if g == "g")
    assert (got["g"].floor, got["g"].half, got["g"].near) == (s[min(int(n * 0.95), n - 1)], s[n // 2], s[round(0.95 * (n - 1))]) and got["h"].half == 1.0


def test_tokens(spark):
    df = spark.createDataFrame([("Cafe\u0301 na\u00efve_x 12 a-b",)], "t string")
    assert df.select(R.tokens(F.col("t"))).first()[0] == ["cafe", "na\u00efve_x", "12", "a", "b"]


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(900, None, 1), (901, [1.0], 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    queries = df.where("vec_id % 50 = 7 OR vec_id = 7").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    got = R.nearest_k(df, queries, 5, others_only=True).collect()
    for q in {r["query"] for r in got}:
        score = {i: float(np.round(unit[i] @ unit[q], 6)) for i in range(300)} | {900: 0.0, 901: 0.0}
        want = sorted((-s, i) for i, s in score.items() if i != q)[:5]
        own = sorted((r.rank, r.id, r.score, r.label) for r in got if r["query"] == q)
        assert [i for _, i, _, _ in own] == [i for _, i in want] and np.allclose([s for *_, s, _ in own], [-s for s, _ in want]) and all(lab == (i % 3 if i < 900 else 1) for _, i, _, lab in own)
    assert R.nearest_k(df.where("false"), queries, 5).count() == 0 and R.nearest_k(df, queries.where("false"), 5).count() == 0
    every = R.nearest(df.where("vec_id < 300"), queries).collect()
    assert len(every) == 300 * queries.count() and all(abs(r.score - unit[r.id] @ unit[r["query"]]) < 1e-5 for r in every)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_approximate_recall(spark, sf):
    from sparkloom import plans

    got = plans.QUERIES["ann_recall"](spark, f"{DATA.rsplit('/', 1)[0]}/{sf}").agg(F.sum("found"), F.sum("wanted")).first()
    assert got[0] >= 0.9 * got[1] > 0


def test_task_state(spark):
    rows = [("a", "pending", '{"x": 1}'), ("b", "gone", "{}"), ("c", "failed", "{"), (None, "failed", "{}"), ("d", None, "{}"), ("e", "completed", '"text"')]
    df = spark.createDataFrame(rows, "task_id string, status string, payload string").withColumn("checkpoint", F.lit(None).cast("string"))
    ok, bad = task_state.tasks(df)
    assert {r.task_id for r in ok.collect()} == {"a", "e"} and bad.count() == 4


def test_task_sources(spark, tmp_path):
    """Tasks from Parquet, and from a database in ranges of their ids, null ids among them."""
    ids = ["0a", "7f3", "9", "abc", "f0", "zz", "", "A1", "é", None]
    rows = [(i, "t", "pending" if n % 3 else "gone", '{"x": 1}' if n % 4 else "{", None, 1) for n, i in enumerate(ids)]
    own = spark.createDataFrame(rows, "task_id string, task_type string, status string, payload string, checkpoint string, attempt_count int")
    whole = own.withColumns({c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at", "completed_at")}).withColumn("error_message", F.lit(None).cast("string")).select(task_state.SCHEMA.names)
    whole.write.parquet(str(tmp_path / "tasks"))
    want = {r[0] for r in rows if r[0] is not None and r[2] == "pending" and r[3] != "{"}
    ok, bad = task_state.read_tasks(spark, str(tmp_path / "tasks"))
    assert {r["task_id"] for r in ok.collect()} == want and bad.count() == len(rows) - len(want)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement().execute
    run("CREATE TABLE task_state (task_id VARCHAR(40), task_type VARCHAR(40), status VARCHAR(20), payload VARCHAR(99), checkpoint VARCHAR(99), attempt_count INT, created_at TIMESTAMP, updated_at TIMESTAMP, completed_at TIMESTAMP, error_message VARCHAR(99))")
    for i, kind, status, payload, _, n in rows:
        own = "NULL" if i is None else f"'{i}'"
        run(f"INSERT INTO task_state VALUES ({own}, '{kind}', '{status}', '{payload}', NULL, {n}, NULL, NULL, NULL, NULL)")
    connection.close()
    ok, bad = task_state.read_tasks_jdbc(spark, url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert {r["task_id"] for r in ok.collect()} == want and bad.count() == len(rows) - len(want)


def test_limits_and_filters(spark):
    rows = [(1, "a", 5), (2, "b", None), (3, None, 7), (4, "a", 9)]
    df = spark.createDataFrame(rows, "id int, kind string, n int")
    ids = lambda must: sorted(r["id"] for r in df.where(RU.matching(must)).collect())
    assert ids({}) == [1, 2, 3, 4] and ids({"kind": "a"}) == [1, 4] and ids({"kind": ["a", "b"]}) == [1, 2, 4] and ids({"kind": None}) == [3]
    assert ids({"n": (6, None)}) == [3, 4] and ids({"kind": "a", "n": (None, 6)}) == [1]
    with pytest.raises(RuntimeError):
        RU.within_limit(df, 3)
    got = RU.multi_get(df, spark.createDataFrame([(1,), (9,)], "id int"), "id", 2)
    assert {(r["id"], r["n"]) for r in got.collect()} == {(1, 5), (9, None)}
    with pytest.raises(RuntimeError):
        RU.multi_get(df, df.select("id"), "id", 3)


def test_truncated(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([1.0],), ([0.0, 0.0, 1.0],), (None,)], "v array<double>")
    short, error = R.truncated(F.col("v"), 2)
    assert [(r[0], r[1]) for r in df.select(short, error).collect()] == [([0.6, 0.8], None), (None, "vector is too short"), (None, "vector is zero"), (None, "no vector")]


def test_desk_rules(spark):
    from sparkloom.functions import desk

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(desk.tool_ttl(F.lit(n))) for n in ("get_stock_price", "get_weather", "search_products", "get_documentation", "get_country_codes", "none")] == [0, 45, 600, 14400, 31536000, 0]
    ttl = lambda n, bad, age: one(desk.adaptive_ttl(F.lit(n), F.lit(bad), F.lit(age).cast("double")))
    assert [ttl(5, 0, 59), ttl(1000, 0, 3600), ttl(1, 1000, 3600), ttl(50, 1, 3600), ttl(1, 1, None)] == [3600, 7200, 3600 * 1.01 * 0.25, 3600 * 1.5 * 0.5, 3600]
    skills = lambda i, tier, mood: one(desk.skills(F.lit(i).cast("string"), F.lit(tier), F.lit(mood)))
    assert skills("billing_dispute", "enterprise", -0.9) == ["billing_specialist", "enterprise_support", "de_escalation"] and skills(None, "basic", 0.0) == ["general_support"]
    assert one(desk.agent(F.lit("complaint"))) == "escalation" and one(desk.agent(F.lit("x"))) == "triage" and one(desk.wait_time(F.lit(None).cast("string"))) == "5-10 minutes"
    out = desk.recovery(F.lit(1), F.lit("c"), F.lit(False), F.lit(None).cast("string"))
    assert [one(v) for v in out.values()] == [False, None, True, "checkpoint corrupted, no backup"]
    out = desk.recovery(F.lit(1), F.lit("c"), F.lit(False), F.lit("b"))
    assert [one(v) for v in out.values()] == [True, "b", False, None]
    assert [one(v) for v in desk.recovery(F.lit(3), F.lit("c"), F.lit(True), F.lit("b")).values()] == [False, None, True, "attempts exceeded"]
