"""Stored indexes, keyed tables, ingest, rollups and migrations: small tables against plain Python."""

import collections
import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import migrate as MG
from sparkloom.operators import retrieval as R
from sparkloom.operators.cells import CellIndex
from sparkloom.operators.ingest import ChunkStore
from sparkloom.operators.postings import InvertedIndex
from sparkloom.operators.rollups import RANK_ERROR, HourlyRollups
from sparkloom.operators.store import KeyedTable
from sparkloom.sources.versions import VersionConflict, VersionedFolder

AT = datetime(2024, 1, 1)


def words(rnd, n):
    return " ".join(f"w{min(int(rnd.expovariate(0.08)), 199)}" for _ in range(n))


def bm25(docs, text, k):
    """Scores by plain Python."""
    own = {i: (t or "").split() for i, t in docs.items()}
    n, mean = len(own), sum(map(len, own.values())) / max(1, len(own)) or 1.0
    df = collections.Counter(w for ws in own.values() for w in set(ws))
    out = {}
    for i, ws in own.items():
        tf = collections.Counter(ws)
        terms = [w for w in text.split() if w in tf]
        if terms:
            out[i] = round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in terms), 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_inverted_index(spark, tmp_path):
    rnd = random.Random(3)
    docs = {i: words(rnd, rnd.choice([3, 20, 60])) for i in range(300)} | {900: None, 901: "", 902: "only here"}
    queries = {1: "w1 w40 w90 w1", 2: "w150 w199", 3: "only", 4: "nowhere", 5: ""}
    asked = spark.createDataFrame(list(queries.items()), "query long, text string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3)
    index = InvertedIndex(spark, str(tmp_path / "ix"), range_docs=16)
    assert index.search(asked, 5).count() == 0

    def same(version=None):
        got = collections.defaultdict(list)
        for r in index.search(asked, 5, version).orderBy("query", "rank").collect():
            got[r["query"]].append((r["doc"], r["score"]))
        for q, text in queries.items():
            want = bm25(now, text, 5)
            assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], atol=2e-6), q

    now = dict(docs)
    first = index.add(frame(docs).unionByName(spark.createDataFrame([(None, "w1")], "doc_id long, text string")))
    same()
    changed = {i: words(rnd, 30) for i in range(0, 300, 7)} | {1000: "w150 w150 only"}  # replaced ones and a new one
    index.add(frame(changed))
    now |= changed
    same()
    index.delete(spark.createDataFrame([(i,) for i in [*range(0, 300, 5), 902, 5000]], "x long"))
    now = {i: t for i, t in now.items() if not (i < 300 and i % 5 == 0) and i != 902}
    same()
    index.merge()
    same()
    index.add(frame({0: "w1 w1 w40"}))  # one that was deleted comes back
    now[0] = "w1 w1 w40"
    same()
    now = docs
    same(first["version"])  # the first version can still be searched


def test_inverted_index_skips(spark, tmp_path):
    """Where few ranges hold good documents, others aren't read; and only the terms' directories are opened."""
    docs = [(i, "common " + ("rare rare rare" if i < 3 else "filler text of no use " * 3)) for i in range(400)]
    index = InvertedIndex(spark, str(tmp_path / "ix"), range_docs=10)
    index.add(spark.createDataFrame(docs, "doc_id long, text string"))
    found, read = index._search(spark.createDataFrame([(1, "common rare")], "query long, text string"), 3)
    assert sorted(r["doc"] for r in found.collect()) == [0, 1, 2]
    row = read.first()
    assert row["blocks_read"] < row["blocks"] / 2
    files = index._blocks(index._manifest(), ["bucket", "term"]).where("bucket IN (3) AND term = 'rare'")
    plan = files._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,rare)" in plan


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([c + 0.1 * rng.normal(size=(60, 16)) for c in centres])
    frame = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(9000, None, 1), (9001, [1.0], 1), (9002, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    queries = frame.where("vec_id % 50 = 0 AND vec_id < 9000").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    index = CellIndex(spark, str(tmp_path / "c"))
    made = index.build(frame, cells=12)
    assert sum(made["sizes"].values()) == len(v) + 3 and made["recall"] >= 0.95
    found, share = index._search(queries, 10)
    rows = found.collect()
    exact = {(r["query"], r["id"]) for r in R.nearest_k(frame, queries, 10).collect()}
    assert len(rows) == 10 * queries.count() and share < 0.5
    assert len({(r["query"], r["id"]) for r in rows} & exact) >= 0.9 * len(exact)
    # More than a cell holds: the next cells are opened, to the last vector.
    everything = index.search(queries.limit(2), 800, probes=1).groupBy("query").count().collect()
    assert [r["count"] for r in everything] == [len(v) + 3] * 2
    assert "PartitionFilters: [cell" in index.search(queries.limit(1), 3)._jdf.queryExecution().toString()
    # Orthogonal vectors have no neighbours: k rows all the same.
    odd = spark.createDataFrame([(i, [float(i == j) for j in range(64)]) for i in range(64)], "vec_id long, embedding array<double>")
    index = CellIndex(spark, str(tmp_path / "o"))
    index.build(odd)
    assert {r["count"] for r in index.search(odd.selectExpr("vec_id AS query", "embedding AS q"), 10).groupBy("query").count().collect()} == {10}
    index = CellIndex(spark, str(tmp_path / "n"))
    index.build(odd.where("false"))
    assert index.search(queries, 3).count() == 0


def outcome(frame):
    return {r[0]: (r[1], r[2]) for r in frame.collect()}


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "kv"), T.StructType.fromDDL("id long, v string"), buckets=8)
    _, first = table.apply(spark.createDataFrame([(i, f"a{i}") for i in range(50)], "id long, v string"), AT)
    later = AT + timedelta(days=1)
    ddl = "id long, v string, op string, seq int, expected long, ttl_seconds double"
    changes = [
        (1, "old", "upsert", 1, None, None), (1, "b", "upsert", 2, None, 60.0), (2, "x", "upsert", 1, 5, None), (3, None, "delete", 1, 1, None),
        (99, "n", "upsert", 1, 0, None), (5, "n", "upsert", 1, 0, None), (98, None, "delete", 1, None, None), (4, "w", "upsert", 1, 1, None), (None, "q", "upsert", 1, None, None),
    ]
    got, second = table.apply(spark.createDataFrame(changes, ddl), later, parent=first["version"])
    assert outcome(got) == {1: ("updated", 2), 2: ("conflict", 1), 3: ("deleted", None), 99: ("inserted", 1), 5: ("conflict", 1), 98: ("absent", None), 4: ("updated", 2), None: ("conflict", 0)}
    rows = {r["id"]: (r["v"], r["row_version"]) for r in table.read().collect()}
    assert rows == {i: (f"a{i}", 1) for i in range(50) if i not in (1, 3, 4)} | {1: ("b", 2), 4: ("w", 2), 99: ("n", 1)}
    # Only touched buckets are new; the old version can be read; expiry; lookups read their buckets.
    untouched = [b for b in first["files"] if first["files"][b] == second["files"][b]]
    assert 0 < len(untouched) < 8 and table.read(first["version"]).where("v LIKE 'a%'").count() == 50
    assert table.read(at=later + timedelta(seconds=61)).where("id = 1").count() == 0 and table.read(at=later).where("id = 1").count() == 1
    assert sorted(r["v"] for r in table.get([1, 3, 99]).collect()) == ["b", "n"]
    assert len(table.get([1]).inputFiles()) < len(table.read().inputFiles())
    some = spark.createDataFrame([(1,), (None,)], "id long")
    assert table.read_for(some).where("id = 1").count() == 1 and len(table.read_for(some).inputFiles()) == len(table.get([1]).inputFiles())
    with pytest.raises(ValueError):
        table.get(list(range(5)), most=4)
    with pytest.raises(VersionConflict):
        table.apply(spark.createDataFrame(changes, ddl), later, parent=first["version"])
    with pytest.raises(VersionConflict):  # two writers from one version
        VersionedFolder(spark, str(tmp_path / "kv")).commit(first["version"], {})
    table.vacuum()
    assert table.read().count() == len(rows)
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "bad"), T.StructType.fromDDL("id long, row_version long"))


def test_keyed_table_random(spark, tmp_path):
    """Batches of changes against a dictionary."""
    rnd = random.Random(9)
    table, plain = KeyedTable(spark, str(tmp_path / "kv"), T.StructType.fromDDL("id string, v long"), buckets=3), {}
    for batch in range(3):
        rows = [(f"k{rnd.randrange(25)}", rnd.randrange(9), rnd.choice(["upsert", "upsert", "delete"]), s, rnd.choice([None, None, 0, 1, 2])) for s in range(20)]
        got = outcome(table.apply(spark.createDataFrame(rows, "id string, v long, op string, seq int, expected long"), AT)[0])
        for k, v, op, _, expected in {r[0]: r for r in rows}.values():
            old = plain.get(k)
            if expected is not None and expected != (old[1] if old else 0):
                assert got[k][0] == "conflict"
            elif op == "delete":
                assert got[k][0] == ("deleted" if plain.pop(k, None) else "absent")
            else:
                plain[k] = (v, old[1] + 1 if old else 1)
                assert got[k] == ("updated" if old else "inserted", plain[k][1])
        assert {r["id"]: (r["v"], r["row_version"]) for r in table.read().collect()} == plain


def test_keyed_table_as_sink(spark, tmp_path):
    """A stream of files into the table; after a restart with the batches sent again nothing is applied twice."""
    source = tmp_path / "in"
    table = KeyedTable(spark, str(tmp_path / "kv"), T.StructType.fromDDL("id long, v string"), buckets=4)
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, v string").parquet(str(source)).writeStream.foreachBatch(table.sink("s", lambda: AT))
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = {1: ("a", 1), 2: ("c", 2), 3: ("d", 1)}
    assert {r["id"]: (r["v"], r["row_version"]) for r in table.read().collect()} == want
    table.sink("s", lambda: AT)(spark.createDataFrame([(1, "again")], "id long, v string"), 1)
    assert {r["id"]: (r["v"], r["row_version"]) for r in table.read().collect()} == want


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "kb"), buckets=4)
    load = lambda rows, **o: {r["doc_id"]: (r["status"], r["chunks"]) for r in store.load(spark.createDataFrame(rows, "doc_id long, text string"), AT, most=40, **o).collect()}
    kept = lambda: {i: sorted(r["content"] for r in rows) for i, rows in _by(store.chunks().collect()).items()}

    def _by(rows):
        out = collections.defaultdict(list)
        for r in rows:
            out[r["doc_id"]].append(r)
        return out

    a, b = "First sentence is here. Second one follows it. Third one too.", "Another text. With two sentences."
    assert load([(1, a), (2, b), (3, ""), (4, None), (5, "x" * 200), (None, "y")], max_chars=100) == {1: ("loaded", 3), 2: ("loaded", 1), 3: ("empty", 0), 4: ("empty", 0), 5: ("failed", 0), None: ("empty", 0)}
    folders = lambda: {r["load"] for r in store.chunks().collect()}
    before = folders()
    assert load([(1, a), (2, b + " More of it here, and more.")], max_chars=100) == {1: ("unchanged", 3), 2: ("loaded", 2)}
    assert before < folders() and len(kept()[1]) == 3 and len(kept()[2]) == 2
    assert load([(1, ""), (2, "z" * 200)], max_chars=100) == {1: ("empty", 0), 2: ("failed", 0)} and kept() == {}  # the old chunks are gone
    assert load([(1, a), (5, "x" * 200)], max_chars=1000) == {1: ("loaded", 3), 5: ("loaded", 1)}
    assert {r["doc_id"]: r["outcome"] for r in store.delete(spark.createDataFrame([(1,), (77,)], "x long"), AT).collect()} == {1: "deleted", 77: "absent"}
    assert set(kept()) == {5}
    assert load([(6, "One. Two."), (6, "Longer one. Two.")]) == {6: ("loaded", 1)} and kept()[6] == ["Longer one. Two."]


def test_rollups(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(AT + timedelta(minutes=rnd.randrange(3000)), rnd.choice(["a", "b"]), rnd.lognormvariate(3, 1)) for _ in range(20000)] + [(None, "a", 1.0), (AT, "a", None)]
    frame = spark.createDataFrame(rows, "ts timestamp, metric string, value double")
    rolled = HourlyRollups(spark, str(tmp_path / "r"))
    assert rolled.report().count() == 0
    rolled.add(frame.where("ts < '2024-01-02' OR ts IS NULL"), "ts", "metric", "value")
    rolled.add(frame.where("ts >= '2024-01-02'"), "ts", "metric", "value")

    def right(start, end):
        for r in rolled.report(start, end).collect():
            own = sorted(v for at, m, v in rows if at and v is not None and m == r["metric"] and (not start or at >= datetime.fromisoformat(start)) and (not end or at < datetime.fromisoformat(end)))
            assert r["n"] == len(own) and abs(r["mean"] - sum(own) / len(own)) < 1e-9 and (r["least"], r["most"]) == (own[0], own[-1])
            for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                assert abs(np.searchsorted(own, r[name]) / len(own) - q) <= RANK_ERROR + 1 / len(own)

    right(None, None)
    right("2024-01-01 05:00:00", "2024-01-02 12:00:00")
    before = {(r["hour"], r["metric"]): r["n"] for r in rolled.hours().collect()}
    rolled.compact()
    assert {(r["hour"], r["metric"]): r["n"] for r in rolled.hours().collect()} == before and len(rolled.folder.manifest()["loads"]) == 1
    right(None, "2024-01-02 01:00:00")
    rolled.keep_since("2024-01-02 00:00:00")
    assert rolled.hours().where("hour < '2024-01-02'").count() == 0 and rolled.hours().count() > 0


STEPS = [
    ("1.0", "1.1", [{"op": "default", "path": "user_preferences", "value": {"language": "en", "timezone": "UTC", "notifications_enabled": True}}]),
    ("1.1", "1.2", [{"op": "rename", "path": "name", "to": "profile.name"}, {"op": "drop", "path": "tmp"}]),
    ("1.2", "2.0", [{"op": "require", "path": "profile.name"}, {"op": "set", "path": "profile.kind", "value": "user"}]),
    ("3.0", "3.1", []),
]


def test_migrations(spark, tmp_path):
    table = spark.createDataFrame([(a, b, json.dumps(s)) for a, b, s in STEPS], "from_version string, to_version string, steps string")
    states = {
        "a": {"x": 1}, "b": {"_schema_version": "1.0", "name": "n", "tmp": 1, "user_preferences": 5}, "c": {"_schema_version": "2.0"}, "d": {"_schema_version": "1.5"},
        "e": {"_schema_version": "3.0"}, "f": {"_schema_version": "1.2", "profile": 3}, "g": {"_schema_version": "1.2", "profile": {"name": "é"}}, "h": {"_schema_version": "x"},
    }
    rows = [(k, json.dumps(v)) for k, v in states.items()] + [("i", None), ("j", "{}"), ("k", "[1]"), ("l", "{broken")]
    frame = spark.createDataFrame(rows, "key string, state string")
    got = {r["key"]: r for r in MG.migrate(frame, table, "1.1", AT).collect()}
    assert json.loads(got["a"]["state"]) == {"x": 1, "user_preferences": STEPS[0][2][0]["value"], "_schema_version": "1.1", "_migrated_at": AT.isoformat()}
    assert json.loads(got["b"]["state"])["user_preferences"] == 5
    got = {r["key"]: r for r in MG.migrate(frame, table, "2.0", AT).collect()}
    outcomes = {k: r["outcome"] for k, r in got.items()}
    assert outcomes == {"a": "failed", "b": "migrated", "c": "already_current", "d": "failed", "e": "failed", "f": "failed", "g": "migrated", "h": "failed", "k": "failed", "l": "failed"}
    assert json.loads(got["b"]["state"])["profile"] == {"name": "n", "kind": "user"} and "tmp" not in json.loads(got["b"]["state"])
    assert json.loads(got["a"]["state"]) == states["a"] and "missing" in got["a"]["error"] and "newer" in got["e"]["error"] and "no path" in got["d"]["error"]
    assert {r["outcome"]: r["n"] for r in MG.counts(MG.migrate(frame, table, "2.0", AT)).collect()} == {"migrated": 2, "already_current": 1, "failed": 7}
    store = KeyedTable(spark, str(tmp_path / "kv"), T.StructType.fromDDL("key string, state string"), buckets=2)
    store.apply(frame.where("key IN ('a', 'b', 'c', 'g')"), AT)
    assert {r["key"]: r["outcome"] for r in MG.migrate_table(store, table, "2.0", AT).collect()} == {"a": "failed", "b": "migrated", "c": "already_current", "g": "migrated"}
    after = {r["key"]: (json.loads(r["state"]).get("_schema_version"), r["row_version"]) for r in store.read().collect()}
    assert after == {"a": (None, 1), "b": ("2.0", 2), "c": ("2.0", 1), "g": ("2.0", 2)}
    twice = table.unionByName(table.limit(1))
    with pytest.raises(MG.MigrationError):
        MG.registry(twice)
