"""Helpers shared by the training-data operators: table access, durable stages and row identity."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the helper columns; they never reach a result.
TMP = "__sl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of each thread the scopes that it is in (scratch), each with the folders made there.
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Only a local session without that setting (tests) gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/sl-{uuid.uuid4().hex}"
    for made in getattr(_scopes, "open", [])[-1:]:
        made.append(path)
    return path


def durable(df: DataFrame, packed: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut and no executor's disk is needed. packed: rows are dealt out to
    files of about the advisory partition size first, so that a narrow table of many partitions isn't many small files."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    (df.hint("rebalance") if packed else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The folders that this thread makes inside are removed at the end: nothing that reads them may be left to run. Scopes of other threads,
    and those around or inside this one, keep theirs."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in made:
            remove(spark, path)


def give_back() -> None:
    """Memory that this process has freed goes back to the system. Allocators keep it else: a Python worker serves one task after another, and
    would hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back, at the end of a task, what the task took."""

    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    held.lean = True
    return held


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """Identity of a row by content, the same on every rerun: 128 bits over the columns, nulls told apart."""
    parts = [c for n in names for c in (F.col(n).isNull(), F.col(n))]
    return F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(7), *parts)))


def drop_tmp(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(TMP)])


def fenced(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the columns names behind a generator of one row: a filter on them isn't pushed below, where Catalyst would
    put the whole expression of a column in place of each mention of it."""
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in names]))))
