"""Token alignment, periodic runs and the quality discriminant against brute force, and held-out accuracy."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import align, periodic, qda
from tests.conftest import DATA

TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two  spaces \n and\tmore "), (6, "a▁b is no piece"), (7, "the cat's <|endoftext|> <s> </s>"), (8, "é ﬁ ① \x00 　wide\xa0space"),
    (9, "the the the the the the"), (9, "the the the the the the"), (10, "a b " * 40 + "c"), (None, "the end of it"), (11, "x" * 3000), (12, "日本語 のテキスト です。"), (13, "the cat sat on the mat. " * 30),
    (14, "tail space "), (15, "a\x1cb \x85c"), (17, "one two three " * 3 + "one two"), (18, "x y x y x y x y z z z z z z z"), (30, "p q r s t u v w x y z " * 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, 8, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, chunk int, groups string").repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def aligned_brute(texts, pair):
    """Whole texts, encoded one by one, and all link counts in a dictionary."""
    per, count = [], collections.Counter()
    for t in texts:
        links, groups, a, b = [], [], [], []
        if t:
            a, b = pair.a.encode(f" {t}", add_special_tokens=False).ids, pair.b.encode(t)
            own, other = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
            if b"".join(own) != f" {t}".encode() or b"".join(other) != f" {t}".encode():
                a, b = [], []
            ends_a, ends_b = np.cumsum([len(x) for x in own]).tolist(), np.cumsum([len(x) for x in other]).tolist()
            if a:
                common = sorted(set(ends_a) & set(ends_b))
                links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in common]
                for lo, hi in zip([0, *common], common):
                    groups.append(",".join(str(i) for i, e in zip(a, ends_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if lo < e <= hi))
        per.append((len(a), len(b), links, ";".join(groups)))
        count.update(links)
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(g.split(";")) if g else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha(g) if g else "") for na, nb, links, g in per]


@pytest.fixture(scope="module")
def pair():
    with open(public_tokenizers.path(align.A_FILE), encoding="utf-8") as f, open(public_tokenizers.path(align.B_FILE), "rb") as g:
        return align.Pair(f.read(), g.read())


def test_alignment(spark, docs, given, pair):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((r["doc_id"] or -1, *(r[c] for c in columns)) for r in align.op11(docs).collect())
    assert got == sorted((i or -1, *x) for (i, _), x in zip(TEXTS, aligned_brute([t for _, t in TEXTS], pair)))
    some = given.where("length(text) < 3000 AND doc_id < 120").select("doc_id", "text").collect()
    frame = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    small = align.align(frame, chunk_bytes=5000)  # many chunks
    got = sorted((r["doc_id"], *(r[c] for c in columns[:-1]), sha(r["groups"]) if r["groups"] else "") for r in small.collect())
    assert got == sorted((r["doc_id"], *x) for r, x in zip(some, aligned_brute([r["text"] for r in some], pair)))


def test_alignment_cuts(pair):
    """Encoding unit by unit is the same as encoding whole texts."""
    rnd = random.Random(5)
    alphabet = ["a", "the", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "é", "é", "1", "12", "'s", "'", "!!", "日", "😀", ".", "\r\n", "▁", "\x00", "ß", "İ", "<s>"]
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 25)))
        units = align.units_of(t)
        assert " ".join(units) == t
        assert [i for u in units for i in pair.a.encode(f" {u}", add_special_tokens=False).ids] == pair.a.encode(f" {t}", add_special_tokens=False).ids
        if "▁" not in t:
            assert [i for u in units for i in pair.b.encode(u)] == pair.b.encode(t), t


def test_alignment_salts(docs, monkeypatch):
    """Stripes that are dealt out by salt give the same result."""
    whole = sorted(map(repr, align.op11(docs).collect()))
    monkeypatch.setattr(align, "CHUNKS_A_SALT", 1)
    assert sorted(map(repr, align.op11(docs).collect())) == whole


def runs_brute(w, least, exponent):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            s = w[i : i + size]
            if j > i and size >= max(least, exponent * q, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_theorem():
    rnd = random.Random(11)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randrange(1, 8)):
            n, k = rnd.randrange(0, 60), rnd.choice([1, 2, 2, 3, 5])
            w = [rnd.randrange(k) for _ in range(n)]
            if n > 4 and rnd.random() < 0.5:
                a, p = rnd.randrange(n), rnd.randrange(1, 6)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
            texts.append(w)
        least, exponent = rnd.choice([(6, 4), (2, 2), (3, 3)])
        got = periodic.runs([np.array(w, np.int64) for w in texts], periodic.RunRules(least, exponent))
        assert [list(map(tuple, g.tolist())) for g in got] == [runs_brute(w, least, exponent) for w in texts]


def op12_brute(doc_id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_brute(w, 6, 4) if n < 400 else [tuple(x) for x in periodic.runs([np.unique(w, return_inverse=True)[1]])[0].tolist()]
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = None
    for s, size, q in found:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    digest = sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id or -1, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def test_runs_of_documents(spark, docs, given):
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for frame in (docs, given):
        got = sorted((repr((r["doc_id"] or -1, *(r[c] for c in columns))) for r in periodic.op12(frame).collect()))
        assert got == sorted(repr(op12_brute(r["doc_id"], r["text"])) for r in frame.collect())
    assert periodic.op12(given).where("n_runs > 0").count() > 10
    texts = {r["doc_id"]: r["collapsed"] for r in periodic.collapse_runs(docs).collect()}
    assert texts[18] == "x y z" and texts[1] == "" and texts[17] == " ".join(["one two three"] * 3 + ["one two"])


def test_discriminant(spark, docs, given):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = qda.op13(given, labels)
    assert got.count() == given.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows} == {0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    # Labels of held-out rows, language, source and id are no inputs.
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = qda.op13(given.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), other)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert all(abs(scores[r["doc_id"]] - r["score"]) < 1e-9 for r in changed.collect())


def test_discriminant_against_plain(spark, given):
    """Moments of tasks, shrinkage and log densities against numpy over all rows at once."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality IS NOT NULL")
    rows = given.join(labels, "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").select("text", "quality").collect()
    x = qda.statistics([(r["text"] or "").encode() for r in rows])
    y = np.array([r["quality"] for r in rows])
    rules, k = qda.QdaRules(), x.shape[1]
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        cov = (1 - rules.to_pooled) * np.cov(x[y == c].T, bias=True) + rules.to_pooled * pooled
        cov = (1 - rules.to_sphere) * cov + rules.to_sphere * np.trace(cov) / k * np.eye(k)
        d = x - x[y == c].mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    odds = (density[1] - density[0]) / rules.temperature + np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    want = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    stats = qda.with_statistics(given)
    model = qda.fit(stats, labels)
    assert np.allclose(model.score(x), want, atol=1e-6)


def test_discriminant_odd_rows(spark, docs):
    schema = "doc_id long, quality int, score double"
    labels = spark.createDataFrame([(9, 1, 0.5), (9, 1, 0.5), (10, 0, 0.1), (None, 1, 0.0), (11, None, 0.0), (12, 7, 0.0), (13, 0, 0.0), (5, 1, 0.0), (999, 1, 0.0)], schema)
    got = qda.op13(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in qda.op13(docs, labels.where("false")).collect()} == {0.5}
    one = {r["score"] for r in qda.op13(docs, spark.createDataFrame([(9, 1, 0.0), (12, 1, 0.0)], schema)).collect()}
    assert len(one) == 1 and one.pop() > 0.5


def test_empty_tables(spark, docs):
    none, labels = docs.where("false"), spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    for frame in (align.op11(none), periodic.op12(none), qda.op13(none, labels)):
        assert frame.count() == 0
