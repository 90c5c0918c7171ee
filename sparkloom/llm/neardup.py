"""Near-duplicate documents by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

1. Document frequencies of words, over all documents. Only words in at least common_share of them weigh less than
   the rest, so the table that goes to all tasks has at most (distinct words a document) / common_share rows.
2. Each document's shingles of five words are weighted by (1 + ln tf / 8) * (1 + mean idf of its words, scaled to 0..1) and
   sampled, and once more without weights; both kinds of samples are hashed in bands, so a pair that is similar by either
   similarity meets with the same probability. Documents with equal texts are one node from here on.
3. In a bucket of a band every node meets a few heads (stars, not all pairs), and each pair is verified once by
   its weighted Jaccard similarity, or that of the shingle sets, over the whole texts. Components of these links follow.
4. In buckets that still hold several components, the nodes outside the largest one (minor nodes) meet some nodes of the
   others, and all of them in small buckets; components follow. The minor nodes that are left in large buckets are then
   held, as a query set, against all of the bucket, in blocks of bounded size. So no texts that share a bucket stay apart
   unverified, and no pairs of a large group are listed. In small buckets only pairs are left out whose numbers of shingles
   and whose sums of weights both rule out the similarity. Some nodes of a large bucket meet early if at least `agreeing` of
   their weighted samples agree in four bits; the blocks, which come last, hold all of its minor nodes against all others.

Defined cases: a null or empty text is never a duplicate; texts without words are duplicates only if equal; texts of
fewer than five words are one shingle; a group's id is its least doc_id; rows repeated whole belong to one group;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, durable, give_back, lean, row_key, text_or_empty
from sparkloom.llm._graph import components

WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b == 95 or b >= 128 else 32 for b in range(256))
#: Keeps a text and itself twice over alike: the weights of shared shingles differ little.
TF_DAMPING = 8


@dataclass(frozen=True)
class NearDupRules:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    set_bands: int = 12
    common_share: float = 0.01
    heads: int = 4
    small: int = 64
    share: int = 32
    agreeing: int = 30
    block_rows: int = 1024
    block_chars: int = 8_000_000
    seed: int = 20240501


class _Words(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _split(text: str) -> list[bytes]:
    return text.lower().encode().translate(WORD_BYTES).split()


def _hashes(text: str, cache: _Words) -> np.ndarray:
    words = _split(text)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class Weights:
    """Shingles of a text and their weights, given the words that are common and their scaled idf."""

    def __init__(self, common: dict[int, float], k: int):
        self.keys = np.array(sorted(common), np.uint64)
        self.idf = np.array([common[int(x)] for x in self.keys], np.float32)
        self.k = k

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(h):
            return h, np.zeros(0, np.float32)
        at = np.searchsorted(self.keys, h)
        idf = np.ones(len(h), np.float32)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            idf = np.where(self.keys[at] == h, self.idf[at], idf)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        s, w = np.zeros(n, np.uint64), np.zeros(n, np.float32)
        for j in range(k):
            s = (s ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
            w += idf[j : j + n]
        shingles, first, tf = np.unique(s, return_index=True, return_counts=True)
        return shingles, ((1 + np.log(tf) / TF_DAMPING) * (1 + w[first] / k)).astype(np.float32)


def _gamma2() -> np.ndarray:
    """65,536 quantiles of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    return x.astype(np.float32)


class Sampler:
    """Consistent weighted samples, and samples of the set: for each of the seeds, a shingle and its quantised weight, and the
    least hash of a shingle. Both kinds come from one hash of the shingle and the seed."""

    def __init__(self, weighted: int, of_set: int, seed: int):
        self.weighted, self.of_set = weighted, of_set
        self.odd = np.random.default_rng(seed).integers(1, 1 << 63, max(weighted, of_set), np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = _gamma2()
        self.ln_c = np.log(self.r)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        n = self.weighted
        best, out = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
        least_hash = np.full(self.of_set, np.iinfo(np.uint64).max)
        ln_w, cols = np.log(weights), np.arange(n)
        for a in range(0, len(shingles), chunk):
            x = shingles[a : a + chunk]
            z = x[:, None] * self.odd
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least_hash, z[:, : self.of_set].min(0), out=least_hash)
            lanes = z[:, :n].view(np.uint16).reshape(len(x), n, 4)  # the three higher ones are independent
            r = self.r.take(lanes[..., 1])
            beta = lanes[..., 3] * np.float32(1 / 65536)
            t = ln_w[a : a + chunk, None] / r
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            beta += self.ln_c.take(lanes[..., 2])  # ln a = ln c - r (t - beta + 1)
            at = beta.argmin(0)
            least = beta[at, cols]
            better = least < best
            best[better] = least[better]
            sample = (x[at] ^ (t[at, cols].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
            out[better] = sample[better]
        return out, least_hash


@lean
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, count), np.uint64, len(count)).view(np.int64)
        values = np.fromiter(count.values(), np.int64, len(count))
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            count.update(set(_split(text.as_py())))
            if len(count) > 1 << 20:
                yield flush()
    if count:
        yield flush()


def common_words(docs: DataFrame, text_col: str, rules: NearDupRules) -> dict[int, float]:
    """Scaled idf (0 for a word of every document, 1 at common_share of them) of the words above common_share."""
    texts = docs.select(text_or_empty(text_col).alias("text"))
    n = texts.count()
    counts = texts.mapInArrow(_document_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > n * rules.common_share)
    top = -np.log(rules.common_share)
    return {r.word & 0xFFFFFFFFFFFFFFFF: float(np.log(n / r.n) / top) for r in counts.toLocalIterator()}


def _signature(samples: np.ndarray) -> list[int]:
    """Four bits of each sample, 16 samples in a 64-bit integer."""
    bits = np.zeros(-len(samples) % 16 + len(samples), np.uint64)
    bits[: len(samples)] = samples >> np.uint64(60)
    shifted = bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(shifted, axis=1).view(np.int64).tolist()


def _agreeing(a: Column, b: Column, rules: NearDupRules) -> Column:
    """How many samples of two signatures have the same four bits."""
    n = rules.bands * rules.rows
    differing = F.lit(0)
    for i in range(-(-n // 16)):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(n) - differing


def _possible(a: str, b: str, rules: NearDupRules) -> Column:
    """False only if sizes or sums a and b rule out the similarity: no Jaccard similarity is over their ratio."""
    return F.least(a, b) >= F.greatest(a, b) * (rules.similarity - 1e-6)


def _banded(samples: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each rows samples."""
    bands = samples.reshape(-1, rows)
    h = np.zeros(len(bands), np.uint64)
    for j in range(rows):
        h = (h ^ bands[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _sketch(common, rules: NearDupRules):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, weights = _Words(), Weights(common.value, rules.shingle)
        sampler = Sampler(rules.bands * rules.rows, rules.set_bands * rules.rows, rules.seed)
        for batch in batches:
            out, signs, sizes, sums = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                shingles, w = weights.of(_hashes(text.as_py(), cache))
                sizes.append(len(shingles))
                sums.append(float(w.sum(dtype=np.float64)))
                if not len(shingles):
                    out.append([])
                    signs.append([])
                    continue
                samples, of_set = sampler(shingles, w)
                signs.append(_signature(samples))
                out.append(np.concatenate([_banded(samples, rules.rows), _banded(of_set, rules.rows)]).tolist())
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            made = [pa.array(out, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *made], [*(batch.schema.names[i] for i in rest), "bands", "signature", "size", "weight"])

    return run


def _similar(a: tuple, b: tuple) -> tuple[float, float]:
    """Weighted Jaccard similarity, and that of the sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(float(a[1].sum() + b[1].sum()) - least, 1e-9), len(both) / max(len(a[0]) + len(b[0]) - len(both), 1)


def _verify(common, rules: NearDupRules):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, weights = _Words(), Weights(common.value, rules.shingle)
        last: tuple = (None, None)
        for batch in batches:
            u, v, a, b = (batch.column(batch.schema.get_field_index(x)) for x in ("u", "v", "text_u", "text_v"))
            linked = []
            for i in range(batch.num_rows):
                if last[0] != (key := u[i].as_py()):
                    last = key, weights.of(_hashes(a[i].as_py(), cache))
                linked.append(max(_similar(last[1], weights.of(_hashes(b[i].as_py(), cache)))) >= rules.similarity)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    return run


def _verify_block(common, rules: NearDupRules):
    def links(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cache, weights = _Words(), Weights(common.value, rules.shingle)
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype=object)
        right = right.set_axis([c[:-2] for c in right.columns], axis=1)
        a, b = ([weights.of(_hashes(t, cache)) for t in side["text"]] for side in (left, right))
        bands = np.stack(right["bands"])
        nodes, comps, minor = right["node"].to_numpy(str), right["comp"].to_numpy(str), right["minor"].to_numpy(bool)
        # The right side's shingles in order, each with its row: sums over a left text's give all its intersections.
        sizes, sums = np.array([len(s) for s, _ in b]), np.array([w.sum(dtype=np.float64) for _, w in b])
        shingles, owner, w = np.concatenate([s for s, _ in b]), np.repeat(np.arange(len(b)), sizes), np.concatenate([w for _, w in b])
        order = np.argsort(shingles)
        shingles, owner, w = shingles[order], owner[order], w[order]
        found = []
        for node, comp, own, (s, own_w) in zip(left["node"], left["comp"], left["bands"], a, strict=True):
            # A pair is verified in the first band that it shares; of two minor nodes, one meets the other.
            once = (comps != comp) & ((bands == np.asarray(own)).argmax(1) == key[0]) & (~minor | (nodes > node))
            if not once.any():
                continue
            start = np.searchsorted(shingles, s)
            n = np.searchsorted(shingles, s, "right") - start
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(b))
            least = np.bincount(owner[at], np.minimum(np.repeat(own_w, n), w[at]), minlength=len(b))
            by_weight = least / np.maximum(own_w.sum(dtype=np.float64) + sums - least, 1e-9)
            by_set = both / np.maximum(len(s) + sizes - both, 1)
            found += [(node, nodes[j]) for j in np.flatnonzero(once & (np.maximum(by_weight, by_set) >= rules.similarity))]
        return pd.DataFrame(found, columns=["u", "v"], dtype=object)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = links(key, left, right)
        give_back()
        return found

    return run


def _meetings(rows: DataFrame, rules: NearDupRules) -> DataFrame:
    """(node, other): minor nodes of rows with all nodes of other components of their bucket that can be similar; in large buckets,
    of which in_blocks sees all pairs, with about share nodes that seem so.

    A pair meets once, in the first band that it shares, and of two minor nodes one meets the other. A pair that a large bucket has first
    and small ones later is left to the blocks, which take it by the same rule."""
    small = F.col("n") <= rules.small
    place = (F.xxhash64("node", F.lit(rules.seed)) / F.lit(float(1 << 63)) + 1) / 2
    others = rows.where(small | (place * F.col("n") < rules.share))
    others = others.select("band", "hash", *[F.col(c).alias(f"other_{c}" if c != "node" else "other") for c in ("node", "comp", "minor", "bands", "signature", "size", "weight")])
    met = rows.where("minor").select("band", "hash", "n", "node", "comp", "bands", "signature", "size", "weight").join(others, ["band", "hash"])
    possible = _possible("size", "other_size", rules) | _possible("weight", "other_weight", rules)
    seem = small | (_agreeing(F.col("signature"), F.col("other_signature"), rules) >= rules.agreeing)
    first = F.array_position(F.zip_with("bands", "other_bands", lambda a, b: a == b), F.lit(True)) == F.col("band") + 1
    one = ~small | ~F.col("other_minor") | (F.col("node") < F.col("other"))  # a large bucket's others are a part of it
    return met.where((F.col("comp") != F.col("other_comp")) & one & possible & seem & first).select("node", "other")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: NearDupRules = NearDupRules()) -> DataFrame:
    """(id, key, node, group_id) for each row of docs: key identifies id and text, node the text, group_id the group."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_words(docs, text_col, rules))
    base, kind = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()
    filled = F.col("text").isNotNull() & (F.col("text") != "")
    keyed = base.withColumn("node", F.when(filled, row_key("text"))).withColumn("key", row_key("id", "text")).withColumn("text", text_or_empty("text"))
    sketches = durable(keyed.mapInArrow(_sketch(common, rules), f"id {kind}, node string, key string, bands array<long>, signature array<long>, size long, weight double"))
    nodes = durable(sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("id", "key"))["key"].alias("key"), *[F.first(c).alias(c) for c in ("bands", "signature", "size", "weight")]))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    sizes = rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = durable(rows.join(durable(sizes.select("band", "hash"), packed=True), ["band", "hash"]))

    needed = durable(nodes.select("node", "key").join(buckets.select("node").distinct(), "node", "left_semi"), packed=True)
    texts = durable(keyed.select("key", "text").join(needed, "key").select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        with_v = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        both = with_v.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
        return durable(both.select("u", "v", "text_u", "text_v").mapInArrow(_verify(common, rules), "u string, v string"))

    def stars(members: DataFrame) -> DataFrame:
        """(u, v): each member of a bucket with the few that come first in it."""
        firsts = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("o"), "node"))["node"] for i in range(rules.heads)]
        heads = durable(members.groupBy("band", "hash").agg(F.array_distinct(F.array(*firsts)).alias("heads")), packed=True)
        return ordered(members.join(heads, ["band", "hash"]).select("node", F.explode("heads").alias("other")))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()

    def leftovers(comps: DataFrame) -> DataFrame:
        """Rows of the buckets that still hold several components; minor are those outside the bucket's largest one."""
        rows = buckets.select("band", "hash", "node").join(comps, "node")
        sizes = durable(rows.groupBy("band", "hash", "comp").agg(F.count(F.lit(1)).alias("n")), packed=True)
        several = sizes.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp"))["comp"].alias("largest")).where("comps > 1")
        rows = rows.join(durable(several.select("band", "hash", "n", "largest"), packed=True), ["band", "hash"]).withColumn("minor", F.expr("comp <> largest")).drop("largest")
        return durable(rows.join(nodes.select("node", "bands", "signature", "size", "weight"), "node"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Links (u, v) of the minor nodes of large buckets to all nodes of other components, block by block."""
        rows = rows.where(F.col("n") > rules.small)
        sizes = durable(rows.select("node").distinct().join(texts.select("node", F.length("text").alias("chars")), "node"), packed=True)
        blocks = lambda chars, n: F.ceil(F.greatest(F.sum(chars) / rules.block_chars, F.sum(n) / rules.block_rows)).cast("int")
        one = F.lit(1)
        counts = rows.join(sizes, "node").groupBy("band", "hash").agg(blocks(F.when(F.col("minor"), F.col("chars")), F.when(F.col("minor"), one)).alias("of_u"), blocks(F.col("chars"), one).alias("of_v"))
        placed = rows.join(durable(counts, packed=True), ["band", "hash"])
        at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys, rest = ["band", "hash", "part_u", "part_v"], ["node", "comp", "minor", "bands"]
        left = placed.where("minor").withColumn("part_u", at("of_u", 1)).withColumn("part_v", each("of_v")).select(*keys, *rest)
        right = placed.withColumn("part_v", at("of_v", 2)).withColumn("part_u", each("of_u")).select(*keys, *rest)
        left, right = left.join(texts, "node"), right.join(texts, "node")
        right = right.select(*[F.col(c).alias(f"{c}_v") for c in left.columns])
        return durable(left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_v" for c in keys])).applyInPandas(_verify_block(common, rules), "u string, v string"))

    def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
        """labels (node, comp) after the components that edges link have become one."""
        of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        links = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("comp_u").alias("u"), F.col("comp_v").alias("v")).where("u <> v").distinct()
        new = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        return durable(labels.join(new, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), packed=True)

    comps = durable(buckets.select("node").distinct().withColumn("comp", F.col("node")), packed=True)
    tested = durable(stars(buckets), packed=True)
    comps = joined(comps, verified(tested))
    pairs = durable(ordered(_meetings(leftovers(comps), rules)).join(tested, ["u", "v"], "left_anti"), packed=True)
    comps = joined(comps, verified(pairs))
    comps = joined(comps, in_blocks(leftovers(comps)))

    grouped = nodes.select("node", F.col("id").alias("least")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = durable(grouped.groupBy("comp").agg(F.min("least").alias("group_id")), packed=True)
    by_node = durable(grouped.join(ids, "comp").select("node", "group_id"), packed=True)
    found = sketches.select("id", "key", "node").join(by_node, "node", "left")
    return found.withColumn("group_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("group_id")))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: NearDupRules = NearDupRules()) -> DataFrame:
    """docs with one row for each group: that with the least id. Columns are those of docs."""
    found = near_duplicates(docs, text_col, id_col, rules)
    heads = found.where(F.col("id").eqNullSafe(F.col("group_id"))).groupBy("key").agg(F.count(F.lit(1)).alias(f"{TMP}n"), F.first("node").alias(f"{TMP}node"), F.first("group_id").alias(f"{TMP}group"))
    # Rows of one group with the same id but other texts: the least key stays.
    first = heads.groupBy(F.col(f"{TMP}group").alias("g"), F.when(F.col(f"{TMP}node").isNull() | F.col(f"{TMP}group").isNull(), F.col("key")).alias("alone")).agg(F.min("key").alias("key"))
    heads = durable(heads.join(durable(first.select("key"), packed=True), "key").select(F.col("key").alias(f"{TMP}key"), f"{TMP}n", f"{TMP}node"), packed=True)
    rows = docs.withColumn(f"{TMP}key", row_key(id_col, text_col)).join(heads, f"{TMP}key")
    repeated = (F.col(f"{TMP}n") > 1) & F.col(f"{TMP}node").isNotNull()
    out = rows.where(~repeated).unionByName(rows.where(repeated).dropDuplicates([f"{TMP}key"]))
    return out.select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "group_id")
