"""Merging any number of replicas of a state by their vector clocks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys whose replicas a task reduces at once, before they are shuffled.
HELD = 50_000


def dominates(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether a is at least b everywhere; what is missing is 0."""
    return all(a.get(k, 0) >= n for k, n in b.items())


def maximal(versions: list[tuple]) -> list[tuple]:
    """Of versions (replica, clock, state) those that no other dominates; of equal clocks the one with the least replica and state."""
    out: list[tuple] = []
    for v in sorted(versions, key=lambda v: (v[0], v[2])):
        if any(dominates(o[1], v[1]) for o in out):
            continue
        out = [o for o in out if not dominates(v[1], o[1])] + [v]
    return sorted(out, key=lambda v: (v[0], v[2]))


def additive(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    """Numbers added, lists joined without repeats, objects merged in turn; other values, and those of two kinds, are b's. Of fields
    that begin with _, b's unless it is empty; a field of one side keeps its value."""
    out = {}
    for k in [*a, *(k for k in b if k not in a)]:
        x, y = a.get(k), b.get(k)
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if k.startswith("_"):
            out[k] = y or x
        elif k not in a or k not in b:
            out[k] = x if k in a else y
        elif number(x) and number(y):
            out[k] = x + y
        elif isinstance(x, list) and isinstance(y, list):
            seen: dict = {}
            for v in [*x, *y]:
                seen.setdefault(json.dumps(v, sort_keys=True), v)
            out[k] = list(seen.values())
        elif isinstance(x, dict) and isinstance(y, dict):
            out[k] = additive(x, y)
        else:
            out[k] = y
    return out


def merge_replicas(replicas: DataFrame, key: str = "key", replica: str = "replica", clock: str = "clock", state: str = "state") -> DataFrame:
    """(key, clock, state, conflict, merged) of replicas (key, replica, clock map<string,bigint>, state as JSON object): versions that another one dominates are
    gone; if one is left it is the result, else the left ones are concurrent, and are added up in the order of their replicas' names, their
    clocks joined. merged is how many versions that took.

    To drop dominated versions is associative and commutative, so each task reduces the versions of its keys before the shuffle and the result
    doesn't depend on order or partitions. What is left of a key is bounded by its concurrent writers. A null clock is empty; a null or broken state is an empty object;
    rows with a null key are left out.
    """
    id_type = replicas.schema[key].dataType.simpleString()
    rows = replicas.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(replica).cast("string"), F.lit("")).alias("replica"), F.to_json(F.coalesce(F.col(clock), F.create_map().cast("map<string,bigint>"))).alias("clock"), F.coalesce(F.col(state), F.lit("{}")).alias("state"))
    schema = f"key {id_type}, replica string, clock string, state string"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(kind: pa.DataType) -> pa.RecordBatch:
            flat = [(k, r, json.dumps(c), s) for k, vs in held.items() for r, c, s in maximal(vs)]
            columns = list(zip(*flat)) if flat else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string()) for c in columns[1:])], ["key", "replica", "clock", "state"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k, r, c, s in zip(*(col.to_pylist() for col in batch.columns)):
                own = held.setdefault(k, [])
                own.append((r, json.loads(c), s))
                if len(own) > 64:
                    held[k] = maximal(own)
            if len(held) > HELD:
                yield out(kind)
                held.clear()
        if kind is not None:
            yield out(kind)

    def loaded(text: str) -> dict:
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            return {}
        return value if isinstance(value, dict) else {}

    def merge(versions: list[tuple]) -> tuple[str, str, bool, int]:
        left = maximal(versions)
        total, joined = loaded(left[0][2]), dict(left[0][1])
        for _, c, s in left[1:]:
            total = additive(total, loaded(s))
            joined = {k: max(joined.get(k, 0), c.get(k, 0)) for k in [*joined, *(k for k in c if k not in joined)]}
        return json.dumps(joined, sort_keys=True), json.dumps(total, sort_keys=True), len(left) > 1, len(left)

    def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: a key's versions are merged when the next key begins."""
        now, held, done, kind = None, [], [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * 5
            types = [kind, pa.string(), pa.string(), pa.bool_(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "clock", "state", "conflict", "merged"])

        for batch in batches:
            kind = batch.column(0).type
            for k, r, c, s in zip(*(col.to_pylist() for col in batch.columns)):
                if held and k != now:
                    done.append((now, *merge(held)))
                    held = []
                now = k
                held.append((r, json.loads(c), s))
                if len(held) > 64 and len(held) & (len(held) - 1) == 0:
                    held = maximal(held)
            if len(done) >= 10_000:
                yield out()
                done.clear()
        if held:
            done.append((now, *merge(held)))
            yield out()

    once = rows.mapInArrow(reduce, schema)
    # A key that most rows have: its tasks' leftovers are reduced once more in as many parts before one task merges them.
    again = once.repartition(F.col("key"), F.pmod(F.xxhash64("replica"), F.lit(16))).mapInArrow(reduce, schema)
    placed = again.repartition("key").sortWithinPartitions("key")
    done = placed.mapInArrow(merge_sorted, f"key {id_type}, clock string, state string, conflict boolean, merged int")
    return done.select(F.col("key").alias(key), F.from_json("clock", "map<string,bigint>").alias("clock"), "state", "conflict", "merged")
