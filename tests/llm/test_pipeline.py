"""The whole pipeline, stage by stage, against plain Python."""

import collections
import hashlib
import math
import os
import re
import unicodedata

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

import corpus_pipeline
from sparkloom.llm import bpe, quality
from sparkloom.llm._common import lean, table
from tests.conftest import DATA

SPACE = r"[\x20\x09-\x0D]+"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def char_class(c):
    kind = unicodedata.category(c)
    tests = ("a" <= c <= "z", re.fullmatch(SPACE, c), kind == "Lu", kind[0] == "L", kind[0] == "N", c in ".,;:!?'\"()-", True)
    return next(i for i, x in enumerate(tests) if x)


def distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0) / 2
    return math.sqrt(min(1, max(0, half(p, q) + half(q, p))))


def judged(docs):
    """doc_id to (char distance, word distance, kept)."""
    rules = quality.QualityRules()
    words, chars = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, t, lang in docs:
        words[lang].update(words_of(t))
        chars[lang].update(map(char_class, t))
    lists = {}
    for lang, count in words.items():
        n = sum(count.values())
        top = sorted((-c, w) for w, c in count.items() if c / n >= rules.min_share)[: rules.common_words]
        lists[lang] = [w for _, w in top], [-c / n for c, _ in top]
    out = {}
    for i, t, lang in docs:
        w, c = words_of(t), collections.Counter(map(char_class, t))
        seen = collections.defaultdict(list)
        for a in range(len(w) - 7):
            seen[tuple(w[a : a + 8])].append(a)
        repeated = {b for at in seen.values() if len(at) > 1 for a in at for b in range(a, a + 8)}
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        by_char = by_word = None
        absent = False
        if len(t) >= rules.min_chars:
            by_char = distance([c[k] / len(t) for k in range(7)], [chars[lang][k] / sum(chars[lang].values()) for k in range(7)])
        if len(w) >= rules.min_words:
            listed, shares = lists[lang]
            count = collections.Counter(w)
            own = [count[x] / len(w) for x in listed]
            by_word = distance([*own, 1 - sum(own)], [*shares, 1 - sum(shares)])
            absent = sum(own) < sum(shares) and distance([sum(own), 1 - sum(own)], [sum(shares), 1 - sum(shares)]) > rules.max_absence_distance
        apart = absent or (by_char or 0) > rules.max_char_distance or (by_word or 0) > rules.max_word_distance
        out[i] = by_char, by_word, not failed and not apart
    return out


def without_lines(docs):
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    holders = collections.defaultdict(set)
    for i, t, _ in docs:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    last = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i), lang) for i, t, lang in docs]


def one_of_each_group(docs):
    split = {i: re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower()) for i, t, _ in docs}
    df = collections.Counter(w for ws in split.values() for w in set(ws))
    idf = {w: math.log(len(docs) / n) / math.log(100) for w, n in df.items() if n > len(docs) / 100}
    weights, holders = {}, collections.defaultdict(list)
    for i, ws in split.items():
        k = min(5, len(ws))
        tf = collections.Counter(tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)) if ws else {}
        weights[i] = {s: (1 + math.log(n) / 8) * (1 + sum(idf.get(w, 1) for w in s) / k) for s, n in tf.items()}
        for s in tf:
            holders[s].append(i)
    group = {i: i for i, _, _ in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in weights.items():
        for j in {j for s in a for j in holders[s] if j < i}:
            b = weights[j]
            both = a.keys() & b.keys()
            least = sum(min(a[s], b[s]) for s in both)
            if max(least / (sum(a.values()) + sum(b.values()) - least), len(both) / (len(a) + len(b) - len(both))) >= 0.8:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    first = {}
    for i, t, _ in docs:
        if t and not split[i]:  # no words: duplicates only if equal
            group[i] = first.setdefault(t, i)
    return [d for d in docs if root(d[0]) == d[0]]


def uncontaminated(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for v in map(find, items):
        for a in range(max(1, len(v) - 12) if v else 0):
            windows[len(v[a : a + 13])].add(tuple(v[a : a + 13]))
    kept = []
    for d in docs:
        w, hit = find(d[1]), set()
        for n, known in windows.items():
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in known:
                    hit.update(range(a, a + n))
        if not hit or 20 * len(hit) < len(w):
            kept.append(d)
    return kept


def test_quality_verdicts(spark):
    rows = table(spark, DATA, "documents")
    want = judged([(r.doc_id, r.text or "", r.lang or "") for r in rows.collect()])
    got = quality.op1(rows).collect()
    assert len(got) == len(want) and {r.kept for r in got} == {True, False}
    for r in got:
        by_char, by_word, kept = want[r.doc_id]
        for x, y in ((r.char_distance, by_char), (r.word_distance, by_word)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 2e-6)
        assert r.kept == kept


def test_pipeline_rows(spark):
    docs = sorted((r.doc_id, r.text or "", r.lang or "") for r in table(spark, DATA, "documents").collect())
    verdicts = judged(docs)
    docs = without_lines([d for d in docs if verdicts[d[0]][2]])
    whole = len(docs)
    docs = one_of_each_group(docs)
    apart = len(docs)
    docs = uncontaminated(docs, [r.text or "" for r in table(spark, DATA, "benchmark").collect()])
    assert whole > apart > len(docs) > 0
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={}).encode_ordinary
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in docs:
        ids = encode(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables; a table without n_chars too."""
    prose = " ".join(f"w{i * 7919 % 1009}" for i in range(300))
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "word " * 30_000, None, "s", None, 2), (3, prose, "en", "s", 9, 3), (4, prose, "en", "s", 9, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    docs = spark.createDataFrame(rows, schema)
    clashing = docs.withColumnsRenamed({"kept": "ids"}).withColumns({"bands": docs.doc_id, "n_words": docs.text, "size": docs.doc_id, "n_lines": docs.text, "spans": docs.source, "items": docs.doc_id, "base_failed": docs.source})
    for (_, stage), n in zip(corpus_pipeline.STAGES[:4], (2, 6, 5, 6)):
        for own in (docs, clashing, docs.drop("n_chars")):
            out = stage(spark, own, DATA)
            assert out.columns == own.columns and out.count() == n
            # Columns that a stage doesn't change come back as they were, whatever their names.
            rest = [c for c in own.columns if c not in ("text", "n_chars")]
            before = collections.Counter(tuple(r[c] for c in rest) for r in own.collect())
            after = collections.Counter(tuple(r[c] for c in rest) for r in out.collect())
            assert out.select(rest).schema == own.select(rest).schema and not after - before
        assert stage(spark, docs.where("false"), DATA).count() == 0
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, clashing, DATA).count() == 6 and last(spark, docs.where("false"), DATA).count() == 0


def test_scratch_of_two_threads(spark):
    """A pipeline's folders aren't removed by another one of the same driver."""
    import threading

    from sparkloom.llm._common import durable, scratch

    first, second, seen = threading.Event(), threading.Event(), []

    def one():
        with scratch(spark):
            df = durable(spark.range(3).toDF("x"))
            first.set()
            second.wait(60)
            seen.append(df.count())

    t = threading.Thread(target=one)
    t.start()
    first.wait(60)
    with scratch(spark):
        inner = durable(spark.range(5).toDF("x"))
        assert inner.count() == 5
    second.set()
    t.join()
    assert seen == [3]


def test_a_task_gives_back_what_it_took(spark):
    """A Python worker serves many tasks: what one took must not stay with it."""

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    def takes(batches):
        for b in batches:
            blocks = [np.ones(64 * 1024, np.uint8) for _ in range(4000)]  # 250 MB in blocks that malloc keeps
            np.kept = blocks[-1]  # and one at the end that stays
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([resident()])], ["pid", "mb"])

    def looks(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([resident()])], ["pid", "mb"])

    one = spark.range(1).coalesce(1)
    (full,), seen = one.mapInArrow(lean(takes), "pid long, mb long").collect(), {}
    for _ in range(8):  # workers take turns
        for r in one.mapInArrow(looks, "pid long, mb long").collect():
            seen[r.pid] = r.mb
    assert seen.get(full.pid, 0) < full.mb - 150


def test_all_stages_give_back_what_their_tasks_took(spark, monkeypatch):
    docs, used = table(spark, DATA, "documents").limit(40), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, func, *a, **k: used.append(func) or plain(self, func, *a, **k))
    for _, stage in corpus_pipeline.STAGES[1:]:
        n = len(used)
        stage(spark, docs, DATA)
        assert len(used) > n and all(getattr(f, "lean", False) for f in used[n:])
