"""Running sums, set joins, routing, replicas and the life cycle as a stream, against plain Python."""

import collections
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import replicas as RP
from sparkloom.operators import routing, scan, sequential
from sparkloom.operators.sets import duplicate_requests
from sparkloom.streaming.lifecycle import life_cycle_stream


def test_running(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randrange(40), i, rnd.choice([None, 1, 5, 7])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o int, id long, v long").repartition(6)
    want, sums, number = {}, collections.Counter(), collections.Counter()
    for g, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[g] += v or 0
        number[g] += 1
        want[i] = (sums[g], number[g])
    out = scan.running(frame, ["g"], ["o", "id"], {"total": F.col("v"), "n": F.lit(1)})
    assert {r["id"]: (r["total"], r["n"]) for r in out.collect()} == want
    every = scan.position(frame, [], [-F.col("o"), "id"]).collect()
    assert [r["id"] for r in sorted(every, key=lambda r: r["position"])] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    left = scan.keep_all_but_lowest(frame, ["o", "id"])
    assert {r["id"] for r in left.collect()} == {r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))[300:]}
    assert scan.position(frame.where("false"), ["g"], ["id"]).count() == 0


def test_duplicate_requests(spark):
    rnd = random.Random(4)
    names = [("pen", 1), ("pen", 2), ("ink", None), (None, 1)]
    requests, items = [], {}
    for i in range(160):
        requests.append((i, rnd.choice(["r1", "r1", "r2", None]), rnd.choice([10.0, 10.0, 10.005, 10.0099, 10.0101, 20.0, None]), 1000 - i if i % 2 else i))
        items[i] = set(rnd.sample(names, rnd.choice([0, 1, 1, 2])))
    lines = [(i, n, v) for i, s in items.items() for n, v in [*s, *s]]  # repeated lines are one item
    own = spark.createDataFrame(requests, "id long, requester string, total double, place long").repartition(4)
    got = {r["id"]: r["duplicate_of"] for r in duplicate_requests(own, spark.createDataFrame(lines, "id long, name string, vendor int"), ["name", "vendor"]).collect()}
    want = {}
    for i, who, total, _ in requests:
        for j, other, sum_, _ in sorted(requests, key=lambda r: (r[3], r[0])):
            if j != i and who is not None and who == other and total is not None and sum_ is not None and items[i] == items[j] and abs(round(total * 10000) - round(sum_ * 10000)) < 100:
                want[i] = j
                break
    assert got == want and len(want) > 50


def test_deliveries(spark):
    topics = ["a.b.c", "a.b", "a", "a.bc", "x..y", "", None, "a.b.c"]
    subs = [("s1", "a.*"), ("s2", "a.b"), ("s3", "a.b.*"), ("s4", "a.b.c"), ("s5", "a.b.c.*"), ("s6", "x.*"), ("s7", "*"), ("s8", "a.*"), ("s8", "a.*"), ("s9", None)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(topics)], "id int, topic string")
    got = sorted((r["id"], r["subscriber"], r["kind"]) for r in routing.deliveries(frame, spark.createDataFrame(subs, "subscriber string, pattern string")).collect())
    want = []
    for i, t in enumerate(topics):
        for s, p in subs if t is not None else []:
            if p is not None and p.endswith(".*"):
                if t == p[:-2] or t.startswith(p[:-1]):
                    want.append((i, s, "wildcard"))
            elif p == t:
                want.append((i, s, "exact"))
    assert got == sorted(want)


def test_best_members(spark):
    rows = [(1, ["x", "y"], True, 4.0), (2, ["x"], True, 5.0), (3, ["x", "x"], True, 5.0), (4, ["x"], False, 9.0), (5, ["y"], None, 9.0), (6, None, True, 9.0), (7, [], True, 9.0)]
    members = spark.createDataFrame(rows, "id long, categories array<string>, good boolean, rating double")
    asked = spark.createDataFrame([("x",), ("y",), ("z",), (None,), ("x",)], "category string")
    best = lambda most: {r["category"]: r["id"] for r in routing.best_members(asked, members, "category", "categories", F.col("good"), F.col("rating"), "id", most).collect()}
    assert best(1000) == {"x": 2, "y": 1, "z": None} and best(1) == {"x": 1, "y": 1, "z": None}


def test_replicas_in_any_order(spark):
    versions = [
        ("k", "a", {"a": 2}, {"n": 1, "tags": ["x", "y"], "deep": {"m": 1, "t": [1]}, "_by": "a", "only": 0}), ("k", "b", {"b": 1}, {"n": 5, "tags": ["y", "z"], "deep": {"m": 2, "t": [2, 1]}, "_by": "", "kind": "t"}),
        ("k", "c", {"a": 1}, {"n": 100}), ("k", "d", {"c": 1, "b": 0}, {"n": 7, "kind": 3}), ("k", "d", {"c": 1}, {"n": 7, "kind": 3}),
        ("w", "a", {"a": 1}, {"v": 1}), ("w", "b", {"a": 1, "b": 1}, {"v": 2}), ("e", "a", None, None), (None, "a", {"a": 1}, {"v": 1}),
    ]
    rows = [(k, r, c, None if s is None else json.dumps(s)) for k, r, c, s in versions]
    seen = set()
    for order in itertools.islice(itertools.permutations(rows), 0, 300000, 60000):
        frame = spark.createDataFrame(list(order), "key string, replica string, clock map<string,bigint>, state string").repartition(random.Random(len(seen)).randrange(1, 5))
        got = {r["key"]: (r["clock"], json.loads(r["state"]), r["conflict"], r["merged"]) for r in RP.merge_replicas(frame).collect()}
        seen.add(repr(sorted(got.items())))
    assert len(seen) == 1
    assert got["w"] == ({"a": 1, "b": 1}, {"v": 2}, False, 1) and got["e"] == ({}, {}, False, 1)
    clock, state, conflict, merged = got["k"]
    assert {k: v for k, v in clock.items() if v} == {"a": 2, "b": 1, "c": 1} and conflict and merged == 3
    assert state == {"n": 13, "tags": ["x", "y", "z"], "deep": {"m": 3, "t": [1, 2]}, "_by": "a", "only": 0, "kind": 3}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_life_cycle_stream(rocks, tmp_path):
    """Three batches, with a restart from the checkpoint between them, give the result of the table."""
    spark, rnd = rocks, random.Random(8)
    events = [(f"t{rnd.randrange(6)}", float(i // 2), i, rnd.choice(["claim", "claim", "fail", "complete", "pause", "resume", "return"])) for i in range(120)]
    schema = "task_id string, at double, id long, event string"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame(events[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(source)
        out = life_cycle_stream(spark.readStream.schema(schema).parquet(source))
        stream = out.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{sink}/batch={i}"))
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: (r["status"], r["attempt"], r["accepted"], r["late"]) for r in spark.read.parquet(sink).collect()}
    want = {r["id"]: (r["status"], r["attempt"], r["accepted"], False) for r in sequential.life_cycle(spark.createDataFrame(events, schema)).collect()}
    assert got == want
    spark.createDataFrame([(events[0][0], 0.0, 500, "claim")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = life_cycle_stream(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{sink}/batch={i}"))
    stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    late = spark.read.parquet(sink).where("id = 500").first()
    assert late["late"] and not late["accepted"]


def test_null_times(spark):
    rows = [("a", None, 1, "claim"), ("a", 1.0, 2, "claim"), ("a", 2.0, 3, "complete")]
    got = {r["id"]: (r["status"], r["accepted"]) for r in sequential.life_cycle(spark.createDataFrame(rows, "task_id string, at double, id int, event string")).collect()}
    assert got == {1: (None, None), 2: ("running", True), 3: ("completed", True)}
