"""A deterministic stand-in for an embedding service."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_codes(text: Column) -> Column:
    """CRC-32 of each lower-case word; the words are cut at white space."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def code_vectors(lists: pa.ListArray, dim: int = 64) -> np.ndarray:
    """The vector of each list of codes: codes signed by their top bit are added up at the code modulo dim, and scaled to length 1."""
    ends = lists.offsets.to_numpy()
    values = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    sums = np.bincount(row * dim + values % dim, np.where(values >> 31, 1.0, -1.0), len(lists) * dim).reshape(-1, dim)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(size == 0, 1, size)


def hash_embed(df: DataFrame, dim: int = 64, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """df with out_col, the code_vectors of its words. Words are cut and coded in the JVM; a batch of arrays is added up at once. A text
    without words is the zero vector."""
    codes = "__codes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(codes)
            flat = code_vectors(batch.column(at), dim).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), vectors], [*(batch.schema.names[i] for i in rest), out_col])

    base = df.drop(out_col).withColumn(codes, word_codes(F.col(text_col)))
    kept = [f for f in base.schema.fields if f.name != codes]
    return base.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))
