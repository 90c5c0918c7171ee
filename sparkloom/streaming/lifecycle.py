"""The life cycle of tasks as a stream with state: what operators.sequential.life_cycle does to a table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.sequential import next_state

STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("at", T.DoubleType()), T.StructField("id", T.LongType())])


class LifeCycle(StatefulProcessor):
    """State of a task: status, attempt, and the time and id of its last event. A batch's events of a task are taken in order; an event
    that comes in a later batch than one after it is late: it changes nothing and is not accepted."""

    def __init__(self, max_attempts: int, ttl_ms: int | None):
        self.max_attempts, self.ttl_ms = max_attempts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        status, attempt, last = ("pending", 0, None) if not self.state.exists() else (lambda s: (s[0], s[1], (s[2], s[3])))(self.state.get())
        out = []
        for at, number, event in zip(events["at"].tolist(), events["id"].tolist(), events["event"].tolist()):
            late = last is not None and (at, number) <= last
            new = (status, attempt) if late else next_state(status, attempt, event, self.max_attempts)
            accepted = not late and new is not None
            if accepted:
                status, attempt = new
            last = last if late else (at, number)
            out.append((key[0], at, number, event, status, attempt, accepted, late))
        self.state.update((status, attempt, *last))
        yield pd.DataFrame(out, columns=["task_id", "at", "id", "event", "status", "attempt", "accepted", "late"])

    def close(self) -> None:
        pass


def life_cycle_stream(events: DataFrame, max_attempts: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """A stream of events (task_id, at in seconds, id, event) with status, attempt, accepted and late. ttl_ms: a task's state is forgotten so long after its
    last event; by default never. A stream with a TTL has batches for the clock alone, so it never ends by itself: don't give it the trigger
    availableNow. Events with a null time or id have no place and are left out. The session's state store must be RocksDB."""
    kind = events.schema["task_id"].dataType.simpleString()
    schema = f"task_id {kind}, at double, id bigint, event string, status string, attempt int, accepted boolean, late boolean"
    placed = events.where("at IS NOT NULL AND id IS NOT NULL")
    return placed.groupBy("task_id").transformWithStateInPandas(LifeCycle(max_attempts, ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime")
