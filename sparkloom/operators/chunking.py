"""Chunkers: texts cut into overlapping pieces, by size, by sentences, by meaning, and in two levels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of sentence ends; only ASCII capitals begin a sentence.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\n+"
ANY_SENTENCE_END = r"(?<=[.!?])\s+"
EDGE = r"^(?U:\s)+|(?U:\s)+$"
#: Semantic chunks are handed on when so many characters have come together.
HELD_CHARS = 4_000_000


def sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    """The sentences of a text without white space at their ends; empty ones are left out, null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), pattern.replace(r"\s", r"(?U:\s)"))
    return F.array_remove(F.transform(parts, lambda s: F.regexp_replace(s, EDGE, "")), "")


def _cut(size: int, overlap: int):
    """State machine of a text's pieces: (start, end) of each, the next starting overlap before the end of the last. A piece
    ends at its last blank if that is past 80 % of it."""

    def pieces(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(text):
            end = at + size
            if end < len(text) and (space := text.rfind(" ", at, end)) - at > 0.8 * size:
                end = space
            yield at, end
            at = max(at + 1, end - overlap)

    return pieces


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start_char, end_char, content) of each piece of size characters; content has no white space at its ends.

    end_char of a last piece may be past the text's end. A null or empty text has no pieces.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    pieces = _cut(size, overlap)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, chunk long, start_char long, end_char long, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a text's pieces at a time
                text = batch.column(1)[i].as_py() or ""
                found = list(pieces(text))
                if found:
                    own = pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type)
                    columns = [own, pa.array(range(len(found)), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*found)), pa.array([text[a:b].strip() for a, b in found], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "chunk", "start_char", "end_char", "content"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sentence_chunks(docs: DataFrame, most: int = 1500, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, first_sentence, n_sentences, content): sentences packed in order while they have at most `most` characters in all.

    A chunk begins with the last `overlap` sentences of the one before. A sentence longer than that is a chunk with what it
    overlaps. The fold is over the sentences' lengths alone, in one expression; a text without sentences has no chunk.
    """
    if most < 1 or overlap < 0:
        raise ValueError("most must be at least 1 and overlap at least 0")
    s = docs.select(F.col(id_col), sentences(F.col(text_col)).alias("s"))
    state = "struct<done:array<struct<a:int,b:int>>,a:int,size:int>"
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("size")).cast(state)
    numbered = F.transform("s", lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i")))

    def add(acc: Column, x: Column) -> Column:
        full = (acc["size"] + x["n"] > most) & (x["i"] > acc["a"])
        first = F.greatest(acc["a"], x["i"] - overlap)
        kept = F.aggregate(F.slice("s", first + 1, x["i"] - first), F.lit(0), lambda t, n: t + F.length(n))
        cut = F.struct(F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), x["i"].alias("b")))).alias("done"), first.alias("a"), (kept + x["n"]).alias("size"))
        more = F.struct(acc["done"].alias("done"), acc["a"].alias("a"), (acc["size"] + x["n"]).alias("size"))
        return F.when(full, cut).otherwise(more).cast(state)

    last = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), F.size("s").alias("b"))))
    # A filter on s, or one that Spark infers from an inner generator, would cut and fold the texts once more.
    cuts = F.when(F.size("s") > 0, F.aggregate(numbered, start, add, last))
    found = s.select(id_col, "s", F.posexplode_outer(cuts).alias("chunk", "c")).where("chunk IS NOT NULL")
    n = F.col("c.b") - F.col("c.a")
    return found.select(id_col, F.col("chunk").cast("long").alias("chunk"), F.col("c.a").cast("long").alias("first_sentence"), n.cast("long").alias("n_sentences"), F.array_join(F.slice("s", F.col("c.a") + 1, n), " ").alias("content"))


def _as_matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def semantic_chunks(docs: DataFrame, threshold: float = 0.75, least: int = 200, most: int = 2000, id_col: str = "doc_id", sentence_col: str = "sentences", vector_col: str = "vectors", embed: Callable[[pa.ListArray], np.ndarray] = _as_matrix) -> DataFrame:
    """(id, chunk, first_sentence, n_sentences, content) from sentences and their vectors (arrays of one length).

    A chunk ends before a sentence whose cosine to the mean of its vectors is below threshold, if it has least characters,
    and before one that would bring it over most. The cosine of a zero vector is 0. embed makes a document's vectors, as rows, of its
    value of vector_col in the task: vectors that can be made of something smaller, like codes of words, needn't be rows or columns.
    """
    if not 0 <= threshold <= 1 or not 1 <= least <= most:
        raise ValueError("threshold is from 0 to 1, and least from 1 to most")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, chunk long, first_sentence long, n_sentences long, content string"

    def apart(mean: np.ndarray, v: np.ndarray) -> bool:
        norm = math.sqrt(mean @ mean) * math.sqrt(v @ v)
        return (float(mean @ v) / norm if norm >= np.finfo(float).eps else 0.0) < threshold

    def bounds(sizes: list[int], vectors: np.ndarray) -> list[int]:
        """Where chunks begin, and the number of sentences."""
        out, total, mean, n = [0], sizes[0], vectors[0], 1
        for i in range(1, len(sizes)):
            v = vectors[i]
            if total + sizes[i] > most or (total >= least and apart(mean, v)):
                out.append(i)
                total, mean, n = sizes[i], v, 1
            else:
                total, mean, n = total + sizes[i], (mean * n + v) / (n + 1), n + 1
        return [*out, len(sizes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, held, rows = batch.column(0).type, 0, []

            def made() -> pa.RecordBatch:
                types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [id_col, "chunk", "first_sentence", "n_sentences", "content"])

            for i in range(batch.num_rows):
                s = batch.column(1)[i].as_py()
                if not s:
                    continue
                sizes, own = list(map(len, s)), batch.column(0)[i].as_py()
                cut = bounds(sizes, embed(batch.column(2)[i].values))
                rows += [(own, k, a, b - a, " ".join(s[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
                held += sum(sizes)
                if held > HELD_CHARS:
                    yield made()
                    held, rows = 0, []
            if rows:
                yield made()

    return docs.select(id_col, sentence_col, vector_col).mapInArrow(run, schema)


def hierarchical_chunks(docs: DataFrame, section: int = 5000, overlap: int = 200, paragraph: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, parent_id, level, place, content): sections by size (level 0), and the chunks of sentences of each (level 1).

    The sections are made once more for their children rather than kept: that costs a scan and no shuffle.
    """
    top = fixed_chunks(docs, section, overlap, id_col, text_col)
    name = lambda *parts: F.concat_ws("_", *parts)
    top = top.withColumn("chunk_id", name(F.col(id_col).cast("string"), F.lit("L0"), F.col("chunk").cast("string")))
    children = sentence_chunks(top.select(F.struct(id_col, F.col("chunk").alias("section"), F.col("chunk_id").alias("parent_id")).alias("of"), "content"), paragraph, 1, "of", "content")
    below = children.select(F.col("of")[id_col].alias(id_col), name(F.col("of")[id_col].cast("string"), F.lit("L1"), F.col("of.section").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), F.col("of.parent_id").alias("parent_id"), F.lit(1).alias("level"), F.col("chunk").alias("place"), "content")
    return top.select(id_col, "chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.col("chunk").alias("place"), "content").unionByName(below)


def with_children(chunks: DataFrame) -> DataFrame:
    """Level 0 of hierarchical_chunks with child_ids, in order. A section's children are bounded by its size."""
    below = chunks.where("level = 1").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("child_ids"))
    return chunks.where("level = 0").drop("parent_id").join(below, "chunk_id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))
