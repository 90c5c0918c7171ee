"""Alignment of the tokens of two tokenizers over the same texts, by dense count matrices in stripes of ids.

A is a byte-level BPE (a tokenizer's JSON), B a BPE over pieces with byte fallback (a SentencePiece model that puts a space before a text).
Both read space + text. Where a token of A and one of B end at the same byte, the two are linked and a group of tokens ends.

1. Neither tokenizer joins characters across a single space that has no white space beside it, so texts are cut there; a test holds the cut
   against whole texts. A task takes chunk_bytes of texts at a time, encodes and aligns each distinct unit of a chunk once, and keeps a document as the
   numbers of its units. A chunk's distinct linked pairs with their counts are dealt out by stripe: the B ids of a stripe are
   STRIPE neighbours. All is written once to the shared folder. Frequent pairs are added up here, so no stripe gets more than one packed row a chunk.
2. A stripe's counts are added into a dense block of STRIPE rows by A's vocabulary (np.add.at), its lists arriving as a sorted stream; blocks of a
   stripe's salts are added in the same way. A salt takes CHUNKS_A_SALT chunks. Each block's row maxima are the best counts.
3. The blocks meet the lists again, by stripe and salt, and every chunk's pairs are answered with their counts and whether that is the
   highest of their B id. Answers go back to their chunks, where units and then documents add them up.

A task holds one block (STRIPE x A's vocabulary x 8 bytes) or one chunk's distinct units, whatever the number of documents.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space + text for A or B (those with U+2581, for instance), have no
tokens: zeros and no groups; repeated rows are aligned and counted each; ties for the highest count are all best; the id may be null or
repeated; columns other than the id and text are ignored; an empty table gives no rows. A very long text without a cut is one unit. Only the driver reads the vocabularies' files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, durable, text_or_empty
from sparkloom.llm.bpe import _pack, _pack_numbers, _planes, _numbers, _unpack, _unpack_numbers

CHUNK_BYTES = 16 << 20
STRIPE = 64
CHUNKS_A_SALT = 4096
#: Units that a tokenizer gets at once, and documents of a result batch.
UNITS, DOCUMENTS = 4096, 512
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Kinds of rows, in the order in which a chunk takes them; lists and blocks are met by stripe.
UNIT_ROWS, ANSWER, DOCUMENT, BLOCK, LIST = range(5)
FIELDS = ("chunk", "kind", "stripe", "at", "n_a", "n_b", "n_groups", "packed")
TYPES = "chunk bigint, kind int, stripe int, at bigint, n_a bigint, n_b bigint, n_groups bigint, packed binary"


@dataclass
class Aligned:
    """Some units: whether both tokenizers keep their bytes, how many tokens and groups they have, the linked pairs (B's id above A's) and the text of
    their groups. A unit that isn't good has none."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    pairs: np.ndarray
    text: list[bytes]


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # A token's number and what follows it in the text of groups: inside a group, at the end of its side, at the end of the unit.
        table = lambda n, ends: np.array([[f"{i}{e}".encode() for i in range(n)] for e in ends], object)
        self.a_text, self.b_text = table(len(self.a_bytes), ",|"), table(len(self.b_bytes), ",;\n")

    def align(self, units: list[str]) -> Iterator[Aligned]:
        """The units (each without the space before it), some at a time."""
        for at in range(0, len(units), UNITS):
            some = units[at : at + UNITS]
            spaced = [f" {u}" for u in some]
            a, b = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(some, num_threads=1)
            raw = [u.encode() for u in spaced]
            whole = b"".join(raw)
            good = np.ones(len(some), bool)
            if any(b"".join([table[i] for i in chain.from_iterable(ids)]) != whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                for u, own in enumerate(raw):
                    good[u] = b"".join([self.a_bytes[i] for i in a[u]]) == own == b"".join([self.b_bytes[i] for i in b[u]])
                a, b = [x if g else [] for x, g in zip(a, good)], [x if g else [] for x, g in zip(b, good)]
            yield self._grouped(a, b, good)

    def _grouped(self, a: list[list[int]], b: list[list[int]], good: np.ndarray) -> Aligned:
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a) if len(b) else np.zeros(0, np.int64)
        last_b = at[last_a]
        ends = end_a[last_a]
        unit = np.repeat(np.arange(len(n_a)), n_a)[last_a]
        groups = np.bincount(unit, minlength=len(n_a))
        # Text of all units: every token with what follows it, in the order of groups, A's before B's.
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[last_a], kind_b[last_b] = 1, 1
        kind_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        pieces = np.concatenate([self.a_text[kind_a, a], self.b_text[kind_b, b]])
        place = np.concatenate([2 * np.searchsorted(ends, end_a), 2 * np.searchsorted(ends, end_b) + 1])
        lines = b"".join(pieces[np.argsort(place, kind="stable")].tolist()).split(b"\n")[:-1]
        text = [b""] * len(n_a)
        for u, line in zip(np.flatnonzero(groups).tolist(), lines):
            text[u] = line
        return Aligned(good, n_a, n_b, groups, b[last_b] << 32 | a[last_a], text)


#: A space between two characters of which neither is white space, for Python or for either tokenizer.
CUT = re.compile(r"(?<=\S) (?=\S)")
WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
BESIDE = [*(f"{w} " for w in WHITE), *(f" {w}" for w in WHITE)]


def units_of(text: str) -> list[str]:
    """The text in units; joined by spaces they are that again."""
    if text[0] == " " or text[-1] == " " or any(x in text for x in BESIDE):
        return CUT.split(text)
    return text.split(" ")


class _Numbered(dict):
    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class _Chunk:
    """Documents of a chunk, as numbers of its units."""

    def __init__(self):
        self.numbers, self.ids, self.docs, self.bytes = _Numbered(), [], [], 0

    def add(self, key: pa.Array, text: str) -> None:
        self.ids.append(key)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, units_of(text)), np.uint32) if text else np.zeros(0, np.uint32))
        self.bytes += len(text)

    def rows(self, pair: Pair, row) -> Iterator[pa.RecordBatch]:
        chunk = uuid.uuid4().int >> 65
        units = list(self.numbers)
        self.numbers = _Numbered()
        n = len(units)
        parts = list(pair.align(units))
        del units
        good, n_a, n_b, links, pairs = (np.concatenate([getattr(p, c) for p in parts]) if parts else np.zeros(0, np.int64) for c in ("good", "n_a", "n_b", "groups", "pairs"))
        text = [x for p in parts for x in p.text]
        del parts
        whole = [bool(good[d].all()) for d in self.docs]
        times = np.zeros(n, np.int64)
        for d, ok in zip(self.docs, whole):
            if ok:
                np.add.at(times, d, 1)
        keys, index = np.unique(pairs, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, index, np.repeat(times, links))
        yield row([pa.nulls(1, self.ids[0].type)], [(chunk, UNIT_ROWS, None, 0, None, None, None, _pack([_planes(links), _planes(index), *text]))])
        stripe = (keys >> 32) // STRIPE
        for s in np.unique(stripe).tolist():
            lo, hi = np.searchsorted(stripe, [s, s + 1]).tolist()
            local = (keys[lo:hi] >> 32) - s * STRIPE
            packed = _pack([_planes(local), _planes(keys[lo:hi] & 0xFFFFFFFF), counts[lo:hi].tobytes()])
            yield row([pa.nulls(1, self.ids[0].type)], [(chunk, LIST, s, lo, None, None, None, packed)])
        for at in range(0, len(self.docs), DOCUMENTS):
            made = []
            for i in range(at, min(at + DOCUMENTS, len(self.docs))):
                d = self.docs[i] if whole[i] else self.docs[i][:0]
                made.append((chunk, DOCUMENT, None, i, int(n_a[d].sum()), int(n_b[d].sum()), int(links[d].sum()), _pack_numbers(d)))
            yield row(self.ids[at : at + DOCUMENTS], made)


def _chunks(a_json, b_model, id_col: str, chunk_bytes: int):
    kinds = dict(zip(FIELDS, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))

    def row(ids: list[pa.Array], values: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(v, t) for v, t in zip(zip(*values), kinds.values())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], [id_col, *(f"{TMP}{f}" for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        pair, chunk = Pair(a_json.value, b_model.value), _Chunk()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk.add(batch.column(0).slice(i, 1), batch.column(1)[i].as_py())
                if chunk.bytes >= chunk_bytes:
                    yield from chunk.rows(pair, row)
                    chunk = _Chunk()
        if chunk.docs:
            yield from chunk.rows(pair, row)

    return run


def _sums(width: int):
    """Counts of each (stripe, salt), which come sorted, as one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros(STRIPE * width, np.int64), None

        def finished() -> pa.RecordBatch:
            at = np.flatnonzero(block)
            packed = _pack([_planes(at // width), _planes(at % width), block[at].tobytes()])
            block[at] = 0
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed], pa.binary())], ["stripe", "salt", "packed"])

        for batch in batches:
            for stripe, salt, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now != (stripe, salt):
                    yield finished()
                now = (stripe, salt)
                b, a, counts = _unpack(packed)
                np.add.at(block, _numbers(b).astype(np.int64) * width + _numbers(a), np.frombuffer(counts, np.int64))
        if now is not None:
            yield finished()

    return run


def _answers(width: int):
    """Lists answered from their stripe's block, which comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((STRIPE, width), np.int64)
        best = np.zeros(STRIPE, np.int64)
        for batch in batches:
            out = []
            for kind, chunk, at, packed in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "at", "packed"))):
                b, a, counts = _unpack(packed)
                b, a = _numbers(b), _numbers(a)
                if kind == BLOCK:
                    block[:] = 0
                    block[b, a] = np.frombuffer(counts, np.int64)
                    best = block.max(axis=1)
                else:
                    counts = block[b, a]
                    out.append((chunk, at, _pack([counts.tobytes(), np.packbits(counts == best[b]).tobytes()])))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "at", "packed"])

    return run


def _documents(id_col: str):
    """Rows of whole chunks, one after another: units, answers, documents."""
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, index, text, counts, best, unit_best, unit_sum = None, *[None] * 7
        for batch in batches:
            kinds, chunks, ats = (batch.column(f"{TMP}{c}").to_pylist() for c in ("kind", "chunk", "at"))
            packed = batch.column(f"{TMP}packed")
            rows, docs, size = [], [], 0

            def made() -> pa.RecordBatch:
                part = batch.take(pa.array(rows, pa.int64()))  # noqa: B023
                n_best, total, groups = zip(*docs)  # noqa: B023
                n = part.column(f"{TMP}n_groups")
                own = [part.column(id_col), part.column(f"{TMP}n_a"), part.column(f"{TMP}n_b"), n, n]
                return pa.RecordBatch.from_arrays([*own, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(groups, pa.binary()).cast(pa.string())], names)

            for i, kind in enumerate(kinds):
                if chunks[i] != now:
                    now, unit_best = chunks[i], None
                    first, second, *text = _unpack(packed[i].as_py())
                    links, index = _numbers(first).astype(np.int64), _numbers(second)
                    n = int(index.max()) + 1 if len(index) else 0
                    counts, best = np.zeros(n, np.int64), np.zeros(n, bool)
                elif kind == ANSWER:
                    c, b = _unpack(packed[i].as_py())
                    c = np.frombuffer(c, np.int64)
                    counts[ats[i] : ats[i] + len(c)] = c
                    best[ats[i] : ats[i] + len(c)] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)).astype(bool)
                else:
                    if unit_best is None:
                        ends = np.concatenate([[0], np.cumsum(links)])
                        added = lambda v: np.concatenate([[0], np.cumsum(v[index])])[ends]  # noqa: B023, E731
                        unit_best, unit_sum = np.diff(added(best.astype(np.int64))), np.diff(added(counts))
                    d = _unpack_numbers(packed[i].as_py())
                    groups = b";".join([text[u] for u in d.tolist()])
                    rows.append(i)
                    docs.append((int(unit_best[d].sum()), int(unit_sum[d].sum()), groups))
                    size += len(groups)
                    if size > CHUNK_BYTES:
                        yield made()
                        rows, docs, size = [], [], 0
            if rows:
                yield made()

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None, b_file: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document. groups lists its groups in order, ids of A and B:
    `a1,a2|b1;a3|b2,b3`. n_best: links whose pair is linked as often in all documents as any pair of its B id; count_sum: the sum of such
    counts over the links. The files are read by the driver."""
    spark = docs.sparkSession
    with open(a_file or public_tokenizers.path(A_FILE), encoding="utf-8") as f:
        a_json = f.read()
    with open(b_file or public_tokenizers.path(B_FILE), "rb") as f:
        b_model = f.read()
    width = len(Pair(a_json, b_model).a_bytes)
    base = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias(f"{TMP}text"))
    key = f"`{id_col}` {base.schema[id_col].dataType.simpleString()}"
    sent = spark.sparkContext.broadcast(a_json), spark.sparkContext.broadcast(b_model)
    stored = durable(base.mapInArrow(_chunks(*sent, id_col, chunk_bytes), f"{key}, " + re.sub(r"(\w+) (\w+)", rf"{TMP}\1 \2", TYPES)))
    column = lambda n: F.col(f"{TMP}{n}")
    chunks = stored.where(column("kind") == UNIT_ROWS).count()
    salts = -(-chunks // CHUNKS_A_SALT) or 1
    salt = F.pmod(F.xxhash64(column("chunk")), F.lit(salts)).cast("int")
    lists = stored.where(column("kind") == LIST).select(column("stripe").alias("stripe"), salt.alias("salt"), column("chunk").alias("chunk"), column("at").alias("at"), column("packed").alias("packed"))

    def added_up(rows: DataFrame) -> DataFrame:
        placed = rows.select("stripe", "salt", "packed").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
        return placed.mapInArrow(_sums(width), "stripe int, salt int, packed binary")

    blocks = added_up(added_up(lists).withColumn("salt", F.lit(0)))
    sent_to = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = lists.withColumn("kind", F.lit(LIST)).unionByName(sent_to.withColumn("kind", F.lit(BLOCK)), allowMissingColumns=True)
    placed = both.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    answers = placed.select("kind", "chunk", "at", "packed").mapInArrow(_answers(width), "chunk bigint, at bigint, packed binary")
    answers = answers.select(*[F.col(c).alias(f"{TMP}{c}") for c in answers.columns], F.lit(ANSWER).alias(f"{TMP}kind"))
    rows = stored.where(column("kind") != LIST).unionByName(answers, allowMissingColumns=True)
    whole = rows.repartition(column("chunk")).sortWithinPartitions(column("chunk"), column("kind"), column("at"))
    counts = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return whole.mapInArrow(_documents(id_col), f"{key}, {counts}, groups string")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's counts and digest of groups."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    return align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)
