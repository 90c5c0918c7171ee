"""Steps whose memory or time must not grow faster than their tables, and odd inputs of the same steps."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom import plans
from sparkloom.functions.embedding import hash_embed
from sparkloom.llm import neardup
from sparkloom.operators import chunking, graph, ingest, postings, retrieval, routing
from sparkloom.plans import conversations, sequential, stored, vectors
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def referenced(rows):
    """Brute force: (conversation, turn) of which a later text holds three words in a row, at every third start."""
    out = set()
    for conv, turn, text in rows:
        w = (text or "").lower().strip(" ").split(" ")
        phrases = [" ".join(w[i : i + 3]) for i in range(0, len(w) - 2, 3)]
        if any(c == conv and n > turn and x is not None and p in x.lower() for c, n, x in rows for p in phrases):
            out.add((conv, turn))
    return out


def test_message_references(spark):
    """Ends of words, double blanks and null texts; and no rows of words are sent to all tasks."""
    rng = random.Random(5)
    words = ["a", "ba", "cab", "ab", "b", "", "bab", "a\nb", "A"]
    rows = [(c, n, rng.choice(["", " "]) + " ".join(rng.choices(words, k=rng.choice([0, 2, 3, 4, 9])))) for c in range(40) for n in range(6)] + [(1, 9, None), (2, 9, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    found = conversations.message_references({"conversations": df}.get)
    want = referenced(rows)
    assert 9 < len(want) < len(rows) and {tuple(r) for r in found.collect()} == want
    assert "BroadcastExchange" not in plan_of(plans.QUERIES["message_references"](spark, DATA))


def test_importance_score_joins(spark):
    """Neither words nor references are sent to all tasks."""
    assert "BroadcastExchange" not in plan_of(plans.QUERIES["importance_score"](spark, DATA))


def test_embedding_preview_zeros(spark):
    """Small negative values are rounded to -0.0, as in the SQL."""
    df = spark.createDataFrame([(1, [-0.00001, 0.00001, -0.0, 0.03125, -0.03125, 1.5]), (2, None)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["head"] for r in vectors.embedding_preview({"embeddings": df}.get).collect()}
    assert repr(got[1]) == "[-0.0, 0.0, -0.0, 0.0313, -0.0313, 1.5]" and got[2] is None


def test_posting_parts_are_bounded(spark, monkeypatch):
    """Words are counted so many at a time, whatever a batch holds; the postings stay the same."""
    monkeypatch.setattr(postings, "HELD_WORDS", 5)
    docs = [(7, ["a", "b", "a"]), (8, []), (9, ["b"] * 9), (10, ["é", "a"]), (11, ["b"]), (12, [])]
    df = spark.createDataFrame([(i, len(w), i % 2, w) for i, w in docs], "doc long, length int, range int, words array<string>").coalesce(1)
    parts = postings._parts(df).collect()
    assert sorted((p["term"], p["range"], tuple(d)) for p in parts for d in p["docs"]) == sorted((x, i % 2, (i, w.count(x), len(w))) for i, w in docs for x in set(w))
    assert len([p for p in parts if p["term"] == "b" and p["range"] == 1]) == 3


def test_delivery_counts(spark):
    """As many as there are deliveries, without making them: no join has more rows than subscriptions."""
    news = spark.createDataFrame([("a.b",)] * 50 + [("a",), ("a.b.c",), ("c",), (None,), ("",)], "topic string")
    subs = spark.createDataFrame([(1, "a.*"), (1, "a.*"), (1, "a.b"), (2, "a.b.*"), (3, "x"), (4, "*"), (5, ".*"), (6, None)], "who int, pattern string")
    want = {tuple(r) for r in routing.deliveries(news, subs).groupBy("who", "kind").count().collect()}
    assert {tuple(r) for r in routing.delivery_counts(news, subs, ["who", "kind"]).collect()} == want and (1, "wildcard", 104) in want


def test_mean_scores(spark):
    """The mean of rounded scores by label, null labels and vectors without a direction among them, from few rows a task."""
    rows = [(i, [float(i % 7 - 3), float(i % 5), 1.0], i % 3 if i % 10 else None) for i in range(200)] + [(900, None, 1), (901, [1.0], 1), (902, [0.0] * 3, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    queries = df.where("vec_id in (3, 50, 902)").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("q"))
    fits = retrieval.nearest(df.where("size(embedding) = 3"), queries).select("query", "label", "score").unionAll(df.where("vec_id IN (900, 901)").crossJoin(queries).select("query", "label", F.lit(0.0)))
    want = {r[:2]: r[2] for r in fits.groupBy("query", "label").agg(F.avg("score")).collect()}
    found = retrieval.mean_scores(df, queries, "label")
    got = {r[:2]: r[2] for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 12 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert "NestedLoop" not in plan_of(plans.QUERIES["rag_confidence"](spark, DATA))


def test_cascade_layers(spark, monkeypatch):
    """Random graphs with cycles, loops, chains and other roots than keys, against plain search; keys that nothing leads to are met once."""
    rng = random.Random(3)
    calls = []
    rounds = graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda e, r: calls.append(r.count()) or rounds(e, r))
    for pairs, roots in (([(i, i // 2) for i in range(1, 60)] + [(i, i // 3) for i in range(60)] + [(0, 5)], [*range(60), 99]), ([(rng.randrange(25), rng.randrange(30)) for _ in range(30)], range(28)), ([(i, i + 1) for i in range(5)], [0])):
        edges = spark.createDataFrame(pairs, "key long, dependent long")
        got = [tuple(r) for r in graph.cascade(edges, spark.createDataFrame([(r,) for r in roots], "key long")).collect()]
        want = set()
        for r in roots:
            seen, todo = {r}, [r]
            while todo:
                k = todo.pop()
                for b in {b for a, b in pairs if a == k} - seen:
                    seen.add(b)
                    todo.append(b)
            want |= {(r, n) for n in seen}
        assert len(got) == len(want) and set(got) == want
    assert calls[0] < 15 and calls[2] == 1


def test_kept_best(spark):
    """A task hands on k rows a query over all its batches, ties by id, as a sort of all scores has them."""
    rng = np.random.default_rng(2)
    kept, every = retrieval.Kept(3, 4), []
    for b in range(40):
        ids, asked = rng.permutation(20) + 20 * (39 - b), np.flatnonzero(rng.random(4) < 0.8)
        score = np.round(rng.random((20, len(asked))), 1)
        kept.add(score, asked, pa.RecordBatch.from_arrays([pa.array(ids)], ["id"]))
        every += [(q, -score[i, j], ids[i]) for i in range(20) for j, q in enumerate(asked)]
    column, score, rows = kept.best()
    assert [(c, -x, i) for c, x, i in zip(column, score, rows.column(0).to_pylist())] == [r for q in range(4) for r in sorted(e for e in every if e[0] == q)[:3]]
    assert retrieval.Kept(3, 4).best() is None


def test_replicas_as_stream(spark):
    """Keys follow one another in a task, without a call or a data frame for each."""
    assert "FlatMapGroupsInPandas" not in plan_of(plans.QUERIES["replica_merge"](spark, DATA))


def test_duplicate_requests_reads(spark):
    """Steps that are used again are made once: only the last comparison of items reads the lines' three parts, for both sides."""
    assert plan_of(plans.QUERIES["duplicate_requests"](spark, DATA)).count("FileScan parquet [l_orderkey") <= 6


def test_nodes_meet_once(spark):
    """However many bands a pair shares it is one row; no pair of two components whose first common bucket is small is left out, and the
    others, which the blocks take, meet in a large bucket only."""
    rng = random.Random(8)
    nodes = [(f"n{i:02}", f"c{i // 2}" if i < 20 else f"n{i:02}", [7 if i < 14 and b < 4 else rng.randrange(4) for b in range(6)]) for i in range(40)]
    held = {}
    for node, comp, bands in nodes:
        for b, h in enumerate(bands):
            held.setdefault((b, h), []).append((node, comp, bands))
    rows = []
    for (b, h), members in held.items():
        comps = [c for _, c, _ in members]
        largest = max(comps, key=lambda c: (comps.count(c), c))
        rows += [(b, h, node, comp, len(members), comp != largest, bands, [0, 0, 0], 10, 10.0) for node, comp, bands in members]
    df = spark.createDataFrame(rows, "band int, hash long, node string, comp string, n long, minor boolean, bands array<long>, signature array<long>, size long, weight double")
    for small in (64, 9):
        met = [tuple(sorted(r)) for r in neardup._meetings(df, neardup.NearDupRules(small=small, share=4)).collect()]
        first = {}
        for (u, cu, bu), (v, cv, bv) in combinations(nodes, 2):
            common = [b for b in range(6) if bu[b] == bv[b]]
            if cu != cv and common:
                first[u, v] = len(held[common[0], bu[common[0]]])
        assert {p for p, n in first.items() if n <= small} <= set(met) <= set(first)
        in_small = [p for p in met if first[p] <= small]
        assert len(in_small) == len(set(in_small)) > 100 and max(met.count(p) for p in met) <= 2


def test_near_duplicates_over_small_and_large_buckets(spark):
    """Pairs are linked whether the first bucket that they share is one of the small ones, a large one, or sampled."""
    base = [f"w{i * 7919 % 1009}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join("x" if i // 5 % 8 == 0 and i % 5 == 0 and i // 40 == k % 5 or i in (3 * k + 7, 3 * k + 60) else w for i, w in enumerate(base)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    linked = [(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(x & y) >= 0.8 * len(x | y)]
    for rules in (neardup.NearDupRules(heads=1, share=0, small=8, block_rows=7), neardup.NearDupRules(heads=1, share=3, small=8, block_rows=7, agreeing=0)):
        found = {r.id: r.group_id for r in neardup.near_duplicates(df, rules=rules).collect()}
        assert linked and all(found[i] == found[j] for i, j in linked)


def test_chunk_semantic_vectors_stay_in_tasks(spark):
    """Vectors made in the task give the chunks that vectors as rows give, and nothing is gathered by document."""
    texts = ["One two. Two three! One  two?", None, "", "x", "A b. " * 300, "É à ö. " + "Word " * 30 + "end. Tail"]
    df = spark.createDataFrame([(i // 2, x) for i, x in enumerate(texts)], "doc_id long, text string")
    s = df.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(chunking.sentences(F.col("text"), chunking.ANY_SENTENCE_END)).alias("pos", "text"))
    rows = hash_embed(s).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "embedding"))).alias("s"))
    want = chunking.semantic_chunks(rows.select("doc_id", F.col("s.text").alias("sentences"), F.col("s.embedding").alias("vectors"))).collect()
    got = sequential.chunk_semantic({"documents": df}.get).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 3
    plan = plan_of(plans.QUERIES["chunk_semantic"](spark, DATA))
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


def test_sentences_are_cut_and_folded_once(spark):
    """No filter, said or inferred, cuts a text or folds its sentences again; texts without sentences have no chunk."""
    df = spark.createDataFrame([(1, "A b. C d. E"), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string")
    chunks = chunking.sentence_chunks(df, 6, 1)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("array_remove(") == 1 and "Filter (size" not in plan and "size(aggregate" not in plan
    assert sorted(map(tuple, chunks.collect())) == [(1, 0, 0, 1, "A b."), (1, 1, 0, 2, "A b. C d."), (1, 2, 1, 2, "C d. E")]


def test_load_keeps_one_copy_of_texts(spark, tmp_path, monkeypatch):
    """Of rows with one id the longest text counts, then the greatest; the step that finds it holds a text once and joins the ledger by the same key."""
    plans_seen = []
    keep = ingest.written
    monkeypatch.setattr(ingest, "written", lambda df: plans_seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    store = ingest.ChunkStore(spark, str(tmp_path / "kb"), buckets=2)
    df = spark.createDataFrame([(1, "A b."), (1, "A c."), (1, None), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    first = {tuple(r) for r in store.load(df, stored.NOW).collect()}
    assert first == {(1, "loaded", 1), (2, "empty", 0), (3, "empty", 0), (None, "empty", 0)}
    assert [r.content for r in store.chunks().collect()] == ["A c."]
    assert {tuple(r) for r in store.load(df, stored.NOW).collect()} == {(1, "unchanged", 1), (2, "unchanged", 0), (3, "unchanged", 0), (None, "empty", 0)}
    assert "max_by" not in plans_seen[0] and plans_seen[0].count("max(struct(") >= 1
