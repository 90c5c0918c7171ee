"""Line dedup with two Bloom filters: hashes seen once, and hashes seen again.

1. Every task hashes the lines of its documents and sends its distinct 64-bit hashes, packed by filter segment. A
   task's hashes that it saw in two documents itself are sent apart.
2. One group per segment puts them into its slice of the two filters: a hash found in the once-seen filter goes into
   the twice-seen filter too. Segments are sized by the count of lines, up to max_filter_bytes in all.
3. The twice-seen filter goes to all tasks. Where max_filter_bytes is reached (at some 90 million lines by default) it is denser, a
   segment gets more hashes, and more lines are suspected, in the end all of them; the result is the same.
4. Only lines suspected by it are shuffled, as digests, for the exact count of documents and the choice of the one to keep.
5. If at most max_broadcast_lines lines are to be dropped somewhere, their digests go to all tasks and no text is
   shuffled. Else documents without a suspected line are passed through, and the others meet their list of lines to drop.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document, and all of them keep
the line if theirs is the largest doc_id; rows without doc_id don't count as documents and keep no repeated line; n_lines and
n_dropped of the input are replaced, other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import TMP, drop_tmp, durable, give_back, lean, row_key, text_or_empty

SPACE = b" \t\n\x0b\f\r"
SEGMENT_BITS = 1 << 23
PROBES = 3


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 40
    min_documents: int = 5
    bits_per_line: int = 12
    max_filter_bytes: int = 128 << 20
    salts: int = 16
    max_broadcast_lines: int = 1 << 20


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _probes(h: np.ndarray) -> np.ndarray:
    """PROBES bit positions in a segment for each hash."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(SEGMENT_BITS) for i in range(PROBES)]).astype(np.int64)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _in_filter(bits: np.ndarray, h: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in _probes(h):
        p = p + base
        found &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found


def _add(bits: np.ndarray, h: np.ndarray) -> None:
    for p in _probes(h):
        np.bitwise_or.at(bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def _local_hashes(segments: int, min_chars: int, limit: int = 1 << 20):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}

        def flush() -> pa.RecordBatch:
            h = np.fromiter(seen.keys(), np.uint64, len(seen))
            again = np.fromiter(seen.values(), bool, len(seen))
            seg = _segment(h, segments)
            order = np.argsort(seg, kind="stable")
            h, again, seg = h[order], again[order], seg[order]
            ids, starts = np.unique(seg, return_index=True)
            ends = [*starts[1:], len(h)]
            once = [h[a:b][~again[a:b]].tobytes() for a, b in zip(starts, ends)]
            twice = [h[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

        for batch in batches:
            for text in batch.column(0):
                keys = {k for x in text.as_py().split(b"\n") if (k := _key(x, min_chars)) is not None}
                for h in map(xxhash.xxh3_64_intdigest, keys):
                    seen[h] = h in seen
            if len(seen) > limit:
                yield flush()
        if seen:
            yield flush()

    return run


def _twice_seen(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's slice of the twice-seen filter. Each packed row holds distinct hashes."""
    once, twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
    segment = None
    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            segment = s
            h, again = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            _add(twice, h[_in_filter(once, h)])
            _add(once, h)
            _add(twice, again)
            _add(once, again)
    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["segment", "bits"])
    give_back()


def _suspected(filter_bits, segments: int, min_chars: int):
    """Adds to each batch the digests of its documents' suspected lines."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits.value, np.uint8)
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index(f"{TMP}bytes")):
                keys = list({k for x in text.as_py().split(b"\n") if (k := _key(x, min_chars)) is not None})
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                hit = _in_filter(bits, h, _segment(h, segments).astype(np.int64) * SEGMENT_BITS)
                found.append([_digest(keys[i]) for i in np.flatnonzero(hit)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.binary()))], [*batch.schema.names, f"{TMP}suspects"])

    return run


def _cleaned(filter_bits, segments: int, repeated, min_chars: int):
    """Adds what is left of each text, its number of lines and how many were dropped. repeated: the digests of lines to drop in
    order, as two halves, and the document that keeps each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits.value, np.uint8)
        high, low, keep = repeated.value
        for batch in batches:
            at = batch.schema.get_field_index
            out, lines, dropped = [], [], []
            for text, own in zip(batch.column(at(f"{TMP}bytes")), batch.column(at(f"{TMP}id"))):
                raw = text.as_py()
                parts = raw.split(b"\n")
                lines.append(len(parts))
                keys = list({k for x in parts if (k := _key(x, min_chars)) is not None})
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                hit = np.flatnonzero(_in_filter(bits, h, _segment(h, segments).astype(np.int64) * SEGMENT_BITS)) if keys and len(high) else ()
                gone = set()
                for i in hit:
                    a, b = np.frombuffer(_digest(keys[i]), ">u8").astype(np.uint64)
                    j, end = np.searchsorted(high, a), np.searchsorted(high, a, "right")
                    j += np.searchsorted(low[j:end], b)
                    if j < end and low[j] == b and keep[int(j)].as_py() != own.as_py():
                        gone.add(keys[i])
                left = [x for x in parts if _key(x, min_chars) not in gone] if gone else parts
                out.append((b"\n".join(left) if gone else raw).decode())
                dropped.append(len(parts) - len(left))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names, f"{TMP}kept", f"{TMP}lines", f"{TMP}dropped"])

    return run


def _rebuild(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            out, lines, dropped = [], [], []
            for text, drops in zip(batch.column(at(f"{TMP}bytes")), batch.column(at(f"{TMP}drops"))):
                parts, drops = text.as_py().split(b"\n"), set(drops.as_py() or ())
                keep = parts if not drops else [x for x in parts if (k := _key(x, min_chars)) is None or _digest(k) not in drops]
                out.append(b"\n".join(keep).decode())
                lines.append(len(parts))
                dropped.append(len(parts) - len(keep))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names, f"{TMP}kept", f"{TMP}lines", f"{TMP}dropped"])

    return run


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: LineRules = LineRules()) -> DataFrame:
    """docs with text replaced by what is kept of it, and n_lines, n_dropped (long)."""
    spark = docs.sparkSession
    sized = docs.select(F.length(text_or_empty(text_col)).alias("n"), text_or_empty(text_col).cast("binary").alias("text"))
    #: A line that counts has min_chars characters, so this bounds the lines.
    most = sized.agg(F.sum(F.least(F.size(F.split(F.col("text").cast("string"), "\n")), F.ceil(F.col("n") / rules.min_chars)))).first()[0] or 0
    segments = max(1, min(-(-most * rules.bits_per_line // SEGMENT_BITS), rules.max_filter_bytes * 8 // SEGMENT_BITS))
    packed = sized.select("text").mapInArrow(_local_hashes(segments, rules.min_chars), "segment long, once binary, twice binary")
    slices = packed.groupBy("segment").applyInArrow(_twice_seen, "segment long, bits binary")
    bits = bytearray(segments * SEGMENT_BITS // 8)
    for row in slices.toLocalIterator():  # max_filter_bytes at most
        bits[row["segment"] * SEGMENT_BITS // 8 : (row["segment"] + 1) * SEGMENT_BITS // 8] = row["bits"]
    filter_bits = spark.sparkContext.broadcast(bytes(bits))

    base = docs.withColumn(f"{TMP}bytes", text_or_empty(text_col).cast("binary")).withColumn(f"{TMP}key", row_key(id_col, text_col))
    narrow = base.select(F.col(id_col).alias(f"{TMP}id"), f"{TMP}key", f"{TMP}bytes")
    with_suspects = lambda df: df.mapInArrow(_suspected(filter_bits, segments, rules.min_chars), T.StructType([*df.schema.fields, T.StructField(f"{TMP}suspects", T.ArrayType(T.BinaryType()))]))
    rows = with_suspects(narrow).select(f"{TMP}id", f"{TMP}key", F.explode(f"{TMP}suspects").alias(f"{TMP}line"))
    suspects = durable(rows.select(F.col(f"{TMP}id").alias("id"), F.col(f"{TMP}key").alias("key"), F.col(f"{TMP}line").alias("line")))
    repeated = durable(suspects.groupBy("line").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= rules.min_documents))
    added = [T.StructField(f"{TMP}kept", T.StringType()), T.StructField(f"{TMP}lines", T.LongType()), T.StructField(f"{TMP}dropped", T.LongType())]

    def finished(out: DataFrame) -> DataFrame:
        return drop_tmp(out.withColumns({text_col: F.col(f"{TMP}kept"), "n_lines": F.col(f"{TMP}lines"), "n_dropped": F.col(f"{TMP}dropped")}))

    if repeated.count() <= rules.max_broadcast_lines:
        known = repeated.select("line", "keep").orderBy("line").toArrow()  # max_broadcast_lines rows at most
        halves = np.frombuffer(b"".join(known.column("line").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        sorted_lines = spark.sparkContext.broadcast((halves[:, 0].copy(), halves[:, 1].copy(), known.column("keep").combine_chunks()))
        marked = base.withColumn(f"{TMP}id", F.col(id_col)).drop(f"{TMP}key", text_col)
        return finished(marked.mapInArrow(_cleaned(filter_bits, segments, sorted_lines, rules.min_chars), T.StructType([*marked.schema.fields, *added])))

    # A line of a third of all documents is one key of this join: it is salted.
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(rules.salts)).cast("int"))
    spread = repeated.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(rules.salts)])))
    drops = salted.join(spread, ["line", "salt"]).where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("key").agg(F.collect_set("line").alias(f"{TMP}drops"))
    drops = drops.withColumnRenamed("key", f"{TMP}drop_key")

    marked = with_suspects(base)
    clean = marked.where(F.size(f"{TMP}suspects") == 0).withColumn(f"{TMP}drops", F.lit(None).cast("array<binary>"))
    other = marked.where(F.size(f"{TMP}suspects") > 0).join(drops, F.col(f"{TMP}key") == F.col(f"{TMP}drop_key"), "left").drop(f"{TMP}drop_key")
    both = clean.unionByName(other).drop(f"{TMP}suspects", f"{TMP}key", text_col)
    return finished(both.mapInArrow(_rebuild(rules.min_chars), T.StructType([*both.schema.fields, *added])))


def op4(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
