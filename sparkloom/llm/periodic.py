"""Periodic runs of words by the runs theorem (Bannai et al., 2017), and texts without their repeats.

A run is a stretch of words with a smallest period q that can't be extended; runs of at least min_exponent periods and min_length words are
reported. Texts are worked on whole, several short ones at a time, as one array of symbols in which no symbol is shared by two texts:

1. The suffix array and its inverse come from prefix doubling, in which only suffixes that are still tied are sorted again. The ranks of
   all rounds are kept and give the LCP array; a sparse table over that answers range minima.
2. For every position the longest Lyndon word under the order of the symbols ends before the next smaller value of the inverse
   suffix array, and the longest one under the reversed order before the next greater value. (The reversed order needs no
   second suffix array: where a Lyndon root decides, two suffixes differ inside the text.)
3. Each Lyndon word is a root that is extended to the right by LCP and to the left by the same tables over the reversed texts. By the theorem every
   run has such a root, so the maximal extensions, without repeats, are all runs. A root of a long run that begins in
   the run's first period leaves at least min_exponent - 2 periods to its right; others are dropped before the left extension, so the reversed tables are built
   only for texts that have such roots.

Words are the stretches without ASCII white space. Time is O(n log n) and memory O(n log n) words of a batch; a batch has BATCH_WORDS words, or one longer text.

Defined cases: a null or empty text has no words and no runs; repeated rows are worked on each; ties of the strongest run go to the
smaller start, then the smaller period; a null id keeps its text; an empty table gives no rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, text_or_empty

BATCH_WORDS = 1 << 18


@dataclass(frozen=True)
class RunRules:
    min_length: int = 6
    min_exponent: int = 4


class Suffixes:
    """Suffix order, LCP and range minima of an array of symbols; -1 ends each text, and the last symbol is -1."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        values = np.unique(symbols)
        first = np.searchsorted(np.sort(symbols), values)
        #: Number of suffixes with a lesser prefix of 1, 2, 4, ... symbols.
        self.ranks = [first[np.searchsorted(values, symbols)].astype(np.int32)]
        # Each end is unlike every other: what follows it belongs to another text.
        ends = np.flatnonzero(symbols < 0)
        self.ranks[0][ends] = np.arange(len(ends), dtype=np.int32)
        tied = self._tied(self.ranks[0], np.arange(n))
        step = 1
        while len(tied):
            old = self.ranks[-1]
            key = old[tied].astype(np.int64) * n + old[tied + step]
            order = np.argsort(key, kind="stable")
            tied, key = tied[order], key[order]
            group = old[tied]
            start = np.searchsorted(group, group)  # groups are in order: first place of each
            fresh = np.empty(len(key), bool)
            fresh[0], fresh[1:] = True, key[1:] != key[:-1]
            place = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            new = old.copy()
            new[tied] = group + (place - start)
            self.ranks.append(new)
            tied = self._tied(new, tied)
            step *= 2
        self.rank = self.ranks[-1]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)
        self.table = self._minima(self._lcp())
        self.ranks = []

    @staticmethod
    def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
        own = rank[among]
        return among[np.bincount(own, minlength=1)[own] > 1]

    def _lcp(self) -> np.ndarray:
        """Common prefix of the suffixes at places i - 1 and i of the order."""
        n = len(self.order)
        lcp = np.zeros(n, np.int32)
        at = np.arange(1, n)
        a, b = self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64)
        same = self.ranks[0][a] == self.ranks[0][b]
        at, a, b = at[same], a[same], b[same]
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[level], 1 << level
            same = rank[a] == rank[b]
            lcp[at[same]] += step
            a, b = a + step * same, b + step * same
        return lcp

    @staticmethod
    def _minima(lcp: np.ndarray) -> list[np.ndarray]:
        table, width = [lcp], 1
        while 2 * width <= len(lcp) and table[-1].any():  # beyond, all minima are 0
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, which differ."""
        lo, hi = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        lo, hi = np.minimum(lo, hi) + 1, np.maximum(lo, hi) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            if k < len(self.table):
                own = np.flatnonzero(level == k)
                out[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << k)])
        return out


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; len(v) if there is none. Values differ."""
    n = len(v)
    out = np.full(n, n, np.int64)
    left = np.arange(n)
    for step in range(1, 17):  # near ones, place by place
        left = left[left + step < n]
        found = v[left + step] < v[left]
        out[left[found]] = left[found] + step
        left = left[~found]
    if len(left):  # far ones: the longest stretches without a smaller value
        table, width = [v], 1
        while 2 * width <= n:
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        at = left + 1
        for level in range(len(table) - 1, -1, -1):
            row = table[level]
            inside = at + (1 << level) <= n
            skip = inside & (row[np.minimum(at, len(row) - 1)] > v[left])
            at = at + (skip.astype(np.int64) << level)
        out[left] = at
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a row, each followed by -1, with symbols that no two texts share; and the first place of each."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.full(begin[-1], -1, np.int64)
    for i, (t, a) in enumerate(zip(texts, begin.tolist())):
        symbols[a : a + len(t)] = t + (i << 32)
    return symbols, begin[:-1]


def runs(texts: list[np.ndarray], rules: RunRules = RunRules()) -> list[np.ndarray]:
    """For each text of word numbers its runs as rows (start, length, period), by start, then period."""
    symbols, begin = _joined(texts)
    none = np.zeros((0, 3), np.int64)
    if len(symbols) < rules.min_length:
        return [none] * len(texts)
    forward = Suffixes(symbols)
    last = len(symbols)
    roots = []
    for v in (forward.rank, -forward.rank):  # both orders
        end = next_smaller(v)
        i = np.flatnonzero((end < last) & (symbols >= 0))
        j = end[i]
        fit = symbols[i] == symbols[np.minimum(j, last - 1)]
        i, j = i[fit], j[fit]
        right = forward.common(i, j)
        # A root in the run's first period: right of it are all periods but the one before its end and itself.
        fit = right > (rules.min_exponent - 2) * (j - i) - 1 if rules.min_exponent > 2 else right >= 0
        roots.append(np.stack([i[fit], j[fit] - i[fit], right[fit]], axis=1))
    i, period, right = np.concatenate(roots).T
    text = np.searchsorted(begin, i, side="right") - 1
    own = np.unique(text)
    out = [none] * len(texts)
    if not len(own):
        return out
    mirrored, mirror_begin = _joined([texts[t][::-1] for t in own.tolist()])
    backward = Suffixes(mirrored)
    size = np.fromiter((len(texts[t]) for t in own.tolist()), np.int64, len(own))
    at = np.searchsorted(own, text)
    # Place p of a text is place size - 1 - p of its mirror image; what ends before i ends before i - 1's image.
    local = i - begin[text]
    inner = local > 0
    left = np.zeros(len(i), np.int64)
    a = mirror_begin[at] + size[at] - local
    left[inner] = backward.common(a[inner], (a - period)[inner])
    length = left + period + right
    fit = (length >= rules.min_length) & (length >= rules.min_exponent * period) & (length >= 2 * period)
    found = np.unique(np.stack([text, local - left, length, period], axis=1)[fit], axis=0)
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    for t in np.unique(found[:, 0]).tolist():
        out[t] = found[slice(*np.searchsorted(found[:, 0], [t, t + 1])), 1:]
    return out


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words are in no run behind that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def collapse_runs(docs: DataFrame, rules: RunRules = RunRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, strongest, collapsed) of each document: its runs as (start, length, period), word numbers from 0; the one with the greatest
    exponent; and its kept words joined by spaces."""
    run = "struct<start:bigint,length:bigint,period:bigint>"
    own = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias(f"{TMP}text"))
    schema = f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string"

    def structs(x: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(x[:, c].astype(np.int64)) for c in range(3)], ["start", "length", "period"], mask=None if mask is None else pa.array(mask))

    def finished(ids: list[pa.Array], texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        found = runs(numbers, rules)
        best = [strongest(f) for f in found]
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs(np.concatenate(found)))
        kept = [b" ".join(w if not len(f) else [w[i] for i in np.flatnonzero(kept_words(len(w), f)).tolist()]) for w, f in zip(texts, found)]
        columns = [pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), lists, structs(np.array([b or (0, 0, 0) for b in best]), np.array([b is None for b in best])), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "strongest", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, numbers, held = [], [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().split()  # bytes are split at ASCII white space only
                if texts and held + len(words) > BATCH_WORDS:
                    yield finished(ids, texts, numbers)
                    ids, texts, numbers, held = [], [], [], 0
                known = _Numbers()
                ids.append(batch.column(0).slice(i, 1))
                texts.append(words)
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                held += len(words) + 1
        if texts:
            yield finished(ids, texts, numbers)

    return own.mapInArrow(work, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the texts of a tenth of the ids repeat themselves from some word on: the contract's test texts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")

    # The array stands behind a lambda, so that it is made once.
    own = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(own, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op12(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """The contract's digests of runs and collapsed texts, over its test texts."""
    found = collapse_runs(with_planted_runs(docs), rules)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
