"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of an Arrow batch of documents. Its words become symbols: each word of the test set has its own, all
others are one separator, and runs of test-set words shorter than the shortest phrase are left out, as no phrase can lie
in them. Over that sequence: suffix array, Burrows-Wheeler transform, wavelet matrix for ranks, and every 16th suffix
position kept. All phrases are searched backward together, their occurrences located by walking to the next kept
position, and merged into removal spans (word numbers). One scan of the documents, no shuffle.

The test set is broadcast in blocks of max_block_bytes at most; if there are several, each makes a scan and the spans
of a document are merged by its key.

Defined cases: a null text has no words and no hits; an item without words is ignored; repeated items count
once; an item with a null id removes words but is not listed; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import TMP, drop_tmp, durable, lean, row_key, text_or_empty

#: Bytes of words: letters in lower case, digits, and all that is not ASCII; every other byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SAMPLE = 16
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = [T.StructField(f"{TMP}n_words", T.LongType()), T.StructField(f"{TMP}spans", SPANS), T.StructField(f"{TMP}items", T.ArrayType(T.LongType()))]


@dataclass(frozen=True)
class ContaminationRules:
    """A document is contaminated if hit words make up at least 1 / share of its words."""

    window: int = 13
    share: int = 20
    shard_bytes: int = 16 << 20
    max_block_bytes: int = 16 << 20


class Phrases:
    """Distinct windows of the items, by length, over the item's own vocabulary (symbols from 2)."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            ids = tuple(self.symbols.setdefault(w, len(self.symbols) + 2) for w in text.translate(WORD_BYTES).split())
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i : i + window], set()).update(() if item_id is None else (item_id,))
        self.groups = []
        for m in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == m]
            self.groups.append((np.array(own, np.int64), [sorted(owners[p]) for p in own]))
        self.shortest = min((len(p) for p in owners), default=0)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling; the last symbol is the smallest and occurs once."""
    rank, h, n = s.astype(np.int64), 1, len(s)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new[order[-1]] == n - 1 or h >= n:
            return order
        rank, h = new, h * 2


class FMIndex:
    """Backward search and locate over integer symbols; s ends with a 0 that occurs nowhere else."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        self.n, sigma = len(s), int(s.max()) + 1
        bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])[:sigma]
        self.sampled = np.where(sa % SAMPLE == 0, sa, -1)
        self.levels = []
        for b in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32)
            self.levels.append((b, zeros, int(zeros[-1])))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, zeros, z in self.levels:
            r = zeros[i]
            i = np.where((c >> b) & 1 == 0, r, z + i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[j] is among the first i[j] symbols of the transform."""
        return self._down(c, i) - self.start[c]

    def step(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one position earlier."""
        c = np.zeros(len(i), np.int64)
        for b, zeros, z in self.levels:
            r = zeros[i]
            one = zeros[i + 1] == r
            c |= one.astype(np.int64) << b
            i = np.where(one, z + i - r, r)
        return self.before[c] + i - self.start[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            known = c < len(self.before)
            hi[alive[~known]] = lo[alive[~known]] = 0
            alive, c = alive[known], c[known]
            lo[alive], hi[alive] = self.before[c] + self.rank(c, lo[alive]), self.before[c] + self.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.sampled[rows[todo]]
            done = found >= 0
            out[todo[done]] = found[done] + steps
            todo = todo[~done]
            rows[todo] = self.step(rows[todo])
            steps += 1
        return out


def _shard(texts: list[bytes], phrases: Phrases) -> tuple[list, list, list]:
    """n_words, spans and items of each text."""
    get, separator = phrases.symbols.get, [1]
    words = [t.translate(WORD_BYTES).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.ones(int(starts[-1]), np.int64)
    for a, w in zip(starts, words):
        ids[a : a + len(w)] = [get(x, 1) for x in w]
    edge = np.flatnonzero(np.diff(np.concatenate([separator, ids, separator]) > 1))
    first, last = edge[::2], edge[1::2]
    long = last - first >= max(1, phrases.shortest)
    first, last = first[long], last[long]
    spans: list = [[] for _ in texts]
    items: list = [[] for _ in texts]
    if not len(first):
        return sizes.tolist(), spans, items
    length = last - first + 1  # with the separator that follows
    place = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    s = np.append(np.append(ids, 1)[place], 0)
    index = FMIndex(s)
    change, owned = np.zeros(len(ids) + 2, np.int64), []
    for group, owners in phrases.groups:
        lo, hi = index.search(group)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        count = hi[hit] - lo[hit]
        rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        at = place[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + group.shape[1], -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(np.stack([doc, np.repeat(hit, count)]), axis=1)
        owned += [(d, o) for d, h in pairs.T.tolist() for o in owners[h]]
    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0])
    edge = np.flatnonzero(np.diff(covered))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
    for d, o in sorted(set(owned)):
        items[d].append(o)
    return sizes.tolist(), spans, items


def _scan(block, rules: ContaminationRules):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, rules.window)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(f"{TMP}bytes"))
            rest = [i for i, n in enumerate(batch.schema.names) if n != f"{TMP}bytes"]
            a, size = 0, 0
            for b in range(1, batch.num_rows + 1):
                size += len(column[b - 1].as_py())
                if size < rules.shard_bytes and b < batch.num_rows:
                    continue
                n, spans, items = _shard(column.slice(a, b - a).to_pylist(), phrases)
                part = batch.slice(a, b - a)
                new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *new], [*(batch.schema.names[i] for i in rest), *(x.name for x in ADDED)])
                a, size = b, 0

    return run


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


@lean
def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, spans, items = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([_merged(x) for x in spans], batch.schema.field(1).type), pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64()))], batch.schema.names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rules: ContaminationRules = ContaminationRules()) -> DataFrame:
    """docs with n_words, spans (word numbers, end exclusive), items, n_hit and contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // rules.max_block_bytes))
    base = docs.withColumn(f"{TMP}bytes", text_or_empty(text_col).cast("binary"))

    def scan(df: DataFrame, b: int) -> DataFrame:
        own = [(r.id, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]  # a block
        kept = [x for x in df.schema.fields if x.name != f"{TMP}bytes"]
        return df.mapInArrow(_scan(spark.sparkContext.broadcast(own), rules), T.StructType([*kept, *ADDED]))

    if blocks == 1:
        out = scan(base, 0)
    else:
        keyed = base.withColumn(f"{TMP}key", row_key(text_col))
        hits = None
        for b in range(blocks):
            part = durable(scan(keyed.select(f"{TMP}key", f"{TMP}bytes"), b).where(F.size(f"{TMP}spans") > 0).dropDuplicates([f"{TMP}key"]).select(f"{TMP}key", f"{TMP}spans", f"{TMP}items"))
            hits = part if hits is None else hits.unionByName(part)
        merged = hits.groupBy(f"{TMP}key").agg(F.flatten(F.collect_list(f"{TMP}spans")).alias(f"{TMP}spans"), F.flatten(F.collect_list(f"{TMP}items")).alias(f"{TMP}items"))
        merged = merged.mapInArrow(_merge_blocks, merged.schema)
        none = scan(keyed, 0).drop(f"{TMP}spans", f"{TMP}items")
        out = none.join(merged, f"{TMP}key", "left").withColumns({f"{TMP}{c}": F.coalesce(f"{TMP}{c}", F.array().cast(t)) for c, t in (("spans", "array<struct<start:int,end:int>>"), ("items", "array<bigint>"))})
    hit = F.aggregate(f"{TMP}spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    out = out.withColumns({"n_words": F.col(f"{TMP}n_words"), "spans": F.col(f"{TMP}spans"), "items": F.col(f"{TMP}items"), "n_hit": hit})
    return drop_tmp(out.withColumn("contaminated", (F.col("n_hit") > 0) & (rules.share * F.col("n_hit") >= F.col("n_words"))))


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")
