"""Folds over ordered rows of a key: what depends on all rows before and on the results for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 10_000


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], added: str) -> DataFrame:
    """df with the columns that step adds. step(state, row) gives the next state and the row's new values (added is their
    schema); start() is the state before a key's first row.

    Rows are dealt out by key and sorted by key and order in each partition, by Spark, which spills; a task reads them as a stream and
    holds one state and one batch, so memory doesn't grow with a key's rows. The rows of one key come one after another in
    one task, as the fold demands. Rows that tie in order come in no defined order, so order should end in an identity. Rows
    whose first order column is null have no place: they are no step, and their new columns are null.
    """
    new = T.DataType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *new.fields])
    arrow, names = to_arrow_schema(schema), df.columns
    unplaced = dict.fromkeys(new.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                rows = batch.slice(a, BATCH).select(names).to_pylist()
                for row in rows:
                    if row[order[0]] is None:
                        row.update(unplaced)
                        continue
                    key = tuple(row[k] for k in keys)
                    if key != now:
                        now, state = key, start()
                    state, values = step(state, row)
                    row.update(values)
                yield pa.RecordBatch.from_pylist(rows, arrow)

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)
