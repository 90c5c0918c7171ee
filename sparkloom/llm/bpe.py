"""Byte-level BPE by a shuffle of distinct words.

1. Each task cuts its documents into pre-tokens, a chunk of chunk_bytes of text at a time. A chunk has its own list of
   distinct words, numbered by how frequent they are; its documents become the numbers of their words by position. The
   list is dealt out in packed rows by word hash. All is written once to the shared folder.
2. A partition for each hash bucket sees all chunks' words of that bucket, encodes each distinct word once, and answers each
   chunk with the ids of its words. Buckets follow the size of the table up to MAX_BUCKETS; a bucket with more than
   KNOWN_WORDS different words forgets them all and goes on, so its memory is bounded and a word may be encoded again.
3. Answers meet the documents of their chunk, which are put together by position.

The plain form, one shuffled row for each pre-token, moves over 20 bytes a pre-token twice; packed, a pre-token takes one
to two bytes and a distinct word of a chunk a few more.

Decoding joins each id with the token-byte table, on the map side: the table has as many rows as the vocabulary, is sent
to all tasks, and an array of ids takes its rows from it in order. A shuffled join would move a row for each token.

Defined cases: a null text is empty and has no ids; a null array of ids decodes to no bytes, and so does a null id; an id that
is not in the vocabulary is an error; repeated rows are encoded each; an empty table gives no rows. Only the driver reads the
vocabulary's file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import TMP, durable, lean, text_or_empty

CHUNK_BYTES = 32 << 20
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 2048
KNOWN_WORDS = 1 << 20
#: Words of a chunk that are numbered by frequency; the others are numbered in the order of the lists.
FREQUENT = 1 << 16
#: Words or ids that are unpacked at once.
PIECE = 1 << 18
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Values of the bucket column: a document, and the first piece of its chunk's numbers (others follow below).
DOCUMENT, NUMBERS = -1, -2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pack_numbers(x: np.ndarray) -> bytes:
    """Byte planes compress well: high bytes are mostly zero. Higher levels gain nothing here."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(x))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return _numbers(zstandard.ZstdDecompressor().decompress(packed))


def _pack(parts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(parts)).tobytes() + _planes(sizes) + b"".join(parts))


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    first = 4 + 4 * int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = first + np.cumsum(_numbers(raw[4:first]), dtype=np.int64)
    return [raw[a:b] for a, b in zip([first, *ends[:-1].tolist()], ends.tolist())]


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _listed(words: list[bytes], counts: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The final number of each word, and (bucket, packed list) rows. A list holds the steps between the numbers of its frequent
    words, the number of its first other word, and all its words."""
    n = len(words)
    frequent = np.argsort(-counts, kind="stable")[:FREQUENT]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, n)
    other = np.ones(n, bool)
    other[frequent] = False
    order = np.array(sorted(range(n), key=words.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    rest = order[other[order]]
    number = np.empty(n, np.uint32)
    number[frequent] = np.arange(len(frequent))
    number[rest] = len(frequent) + np.arange(len(rest))
    first = frequent[np.argsort(bucket[frequent], kind="stable")]
    rows = []
    for b in np.unique(bucket).tolist():
        own = first[slice(*np.searchsorted(bucket[first], [b, b + 1]))]
        lo, hi = np.searchsorted(bucket[rest], [b, b + 1]).tolist()
        head = [_planes(np.diff(number[own], prepend=np.uint32(0))), np.uint32(len(frequent) + lo).tobytes()]
        rows.append((b, _pack([*head, *(words[i] for i in own.tolist()), *(words[i] for i in rest[lo:hi].tolist())])))
    return number, rows


def _pre_tokens(pattern: str, buckets: int, chunk_bytes: int, schema: pa.Schema):
    """Rows of the own columns and chunk, part, bucket, at, size, packed: the documents, numbers and lists of each chunk."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex  # only where texts are cut

        # White space as the tokenizer's library has it, without the four separators that Python adds.
        cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        task, chunks = TaskContext.get().partitionId(), 0
        own = [n for n in schema.names if not n.startswith(TMP)]

        def rows(columns: list | None, bucket: list[int], at: np.ndarray, size: np.ndarray, packed: list, chunk: int) -> pa.RecordBatch:
            n = len(bucket)
            columns = [pa.nulls(n, schema.field(c).type) for c in own] if columns is None else columns
            part = (task + chunks * 7919) % (1 << 31)  # the chunks of one number come to different partitions
            new = [pa.array([chunk] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *new], [*own, *(f"{TMP}{c}" for c in ("chunk", "part", "bucket", "at", "size", "packed"))])

        def finished() -> Iterator[pa.RecordBatch]:
            chunk, at = uuid.uuid4().int >> 65, 0
            sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
            for n, columns in held:
                yield rows(columns, [DOCUMENT] * n, np.arange(at, at + n), sizes[at : at + n], [None] * n, chunk)
                at += n
            held.clear()
            flat = np.concatenate(numbers)
            numbers.clear()
            encoded = [w.encode() for w in words]
            words.clear()
            number, lists = _listed(encoded, np.bincount(flat, minlength=len(encoded)), buckets)
            flat = number[flat]
            none = np.full(1, -1)
            for i, a in enumerate(range(0, len(flat), PIECE)):
                yield rows(None, [NUMBERS - i], none, none, [_pack_numbers(flat[a : a + PIECE])], chunk)
            for b, packed in lists:
                yield rows(None, [b], none, none, [packed], chunk)

        words, held, numbers, size = _Numbered(), [], [], 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(f"{TMP}text"))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in own]
            part = lambda a, n: (n, [c.take(pa.array(np.arange(a, a + n))) for c in columns])  # noqa: B023, E731  a copy, so that the texts can go
            a = 0
            for b in range(batch.num_rows):
                text = texts[b].as_py()
                found = cut.findall(text) if len(text) < PIECE else (m[0] for m in cut.finditer(text))  # no list of a long text's words
                numbers.append(np.fromiter(map(words.__getitem__, found), np.uint32))
                size += len(text)
                if size >= chunk_bytes:
                    held.append(part(a, b + 1 - a))
                    yield from finished()
                    size, a, chunks = 0, b + 1, chunks + 1
            if a < batch.num_rows:
                held.append(part(a, batch.num_rows - a))
        if held:
            yield from finished()

    return run


def _encode_words(ranks, pattern: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(f"{TMP}packed"))
            rest = [n for n in batch.schema.names if n != f"{TMP}packed"]
            for i in range(batch.num_rows):
                frequent, base, *words = _unpack(packed[i].as_py())
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w.decode()), "<u4").tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.uint32, len(ids))
                answer = _pack([frequent, base, _pack_numbers(sizes), _pack_numbers(np.frombuffer(b"".join(ids), "<u4"))])
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, 1) for n in rest), pa.array([answer], pa.binary())], [*rest, f"{TMP}packed"])

    return run


def _chunk(rows: list[pa.RecordBatch], own: list[str]) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, in order, with their ids; at most about PIECE pre-tokens a batch (or one document)."""
    docs, pieces, parts = [], {}, []
    for batch in rows:
        bucket = batch.column(f"{TMP}bucket").to_numpy()
        if (is_doc := bucket == DOCUMENT).any():
            docs.append(batch.filter(pa.array(is_doc)).select([*own, f"{TMP}size"]))
        for i in np.flatnonzero(~is_doc).tolist():
            packed = batch.column(f"{TMP}packed")[i].as_py()
            if bucket[i] < 0:
                pieces[-bucket[i]] = _unpack_numbers(packed)
            else:
                frequent, base, sizes, ids = _unpack(packed)
                frequent, sizes = np.cumsum(_numbers(frequent)), _unpack_numbers(sizes)
                others = np.frombuffer(base, "<u4")[0] + np.arange(len(sizes) - len(frequent))
                parts.append((np.concatenate([frequent, others]).astype(np.int64), sizes.astype(np.int64), _unpack_numbers(ids).astype(np.int32)))
    n = sum(len(p[0]) for p in parts)
    start, length, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for order, sizes, ids in parts:
        length[order], start[order] = sizes, base + np.cumsum(sizes) - sizes
        base += len(ids)
    flat = np.concatenate([np.zeros(0, np.int32), *(p[2] for p in parts)])
    words = np.concatenate([np.zeros(0, np.uint32), *(pieces[i] for i in sorted(pieces))])
    del parts, pieces

    def ids_of(a: int, b: int) -> Iterator[np.ndarray]:
        for at in (words[i : min(b, i + PIECE)] for i in range(a, b, PIECE)):
            size, ends = length[at], np.cumsum(length[at])
            yield flat[np.repeat(start[at] - (ends - size), size) + np.arange(int(size.sum()))]

    done = 0
    for batch in docs:
        ends = done + np.cumsum(batch.column(f"{TMP}size").to_numpy())
        row = 0
        while row < batch.num_rows:
            last = min(batch.num_rows, max(row + 1, int(np.searchsorted(ends, done + PIECE, "right"))))
            counted = np.concatenate([[0], np.cumsum(length[words[done : ends[last - 1]]])])
            starts = np.concatenate([[done], ends[row:last]]) - done
            ids = np.concatenate([np.zeros(0, np.int32), *ids_of(done, int(ends[last - 1]))])
            part = batch.slice(row, last - row)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.ListArray.from_arrays(pa.array(counted[starts], pa.int32()), pa.array(ids))], [*own, f"{TMP}ids"])
            row, done = last, int(ends[last - 1])


def _reassemble(own: list[str]):
    """Takes the rows of whole chunks, one chunk after another, a chunk's documents in order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            chunk = batch.column(f"{TMP}chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b and chunk[a] != now:
                    if held:
                        yield from _chunk(held, own)
                    held, now = [], chunk[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _chunk(held, own)

    return run


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without text_col, with ids (array<int>). vocabulary: a file of ranks that the driver can read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    base = docs.withColumn(f"{TMP}text", text_or_empty(text_col)).drop(text_col, ids_col)
    size = base.agg(F.sum(F.octet_length(f"{TMP}text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(MAX_BUCKETS, max(least, -(-size // BUCKET_BYTES))))
    own = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema.fields if f.name != f"{TMP}text"])
    added = [(n, T.BinaryType() if n == "packed" else T.IntegerType() if n in ("part", "bucket") else T.LongType()) for n in ("chunk", "part", "bucket", "at", "size", "packed")]
    made = T.StructType([*own.fields, *(T.StructField(f"{TMP}{n}", t) for n, t in added)])
    table = durable(base.mapInArrow(_pre_tokens(pattern, buckets, chunk_bytes, to_arrow_schema(own)), made))
    bucket, part = F.col(f"{TMP}bucket"), F.col(f"{TMP}part")
    lists = table.where(bucket >= 0).select(f"{TMP}chunk", f"{TMP}part", f"{TMP}bucket", f"{TMP}packed")
    answers = lists.repartitionById(buckets, bucket).mapInArrow(_encode_words(ranks, pattern), lists.schema)
    rows = table.where(bucket < 0).unionByName(answers, allowMissingColumns=True)
    parts = max(least, -(-size // max(chunk_bytes, CHUNK_BYTES)))
    placed = rows.repartitionById(parts, F.pmod(part, F.lit(parts))).sortWithinPartitions(f"{TMP}chunk", F.col(f"{TMP}at").asc_nulls_first())
    result = T.StructType([*own.fields, T.StructField(f"{TMP}ids", T.ArrayType(T.IntegerType()))])
    return placed.mapInArrow(_reassemble(own.names), result).withColumnRenamed(f"{TMP}ids", ids_col)


def _decode(tokens, ids_col: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens.value, pa.binary())
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            if ids.null_count:
                ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
            at, row = ids.offsets.to_numpy(), 0
            while row < batch.num_rows:
                last = min(batch.num_rows, max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1))
                taken = table.take(ids.values.slice(at[row], at[last] - at[row]))
                ends = np.frombuffer(taken.buffers()[1], np.int32) if len(taken) else np.zeros(1, np.int32)
                bounds = np.ascontiguousarray(ends[at[row : last + 1] - at[row]])
                decoded = pa.BinaryArray.from_buffers(pa.binary(), last - row, [None, pa.py_buffer(bounds), taken.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*batch.slice(row, last - row).columns, decoded], [*batch.schema.names, f"{TMP}decoded"])
                row = last

    return run


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, decoded_col: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    df = df.drop(decoded_col)
    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    token: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        token[i] = b
    schema = T.StructType([*df.schema.fields, T.StructField(f"{TMP}decoded", T.BinaryType())])
    return df.mapInArrow(_decode(df.sparkSession.sparkContext.broadcast(token), ids_col), schema).withColumnRenamed(f"{TMP}decoded", decoded_col)


def op6(docs: DataFrame) -> DataFrame:
    both = decode(encode(docs.select("doc_id", "text")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
