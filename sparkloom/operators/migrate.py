"""Migrations of stored states along versions of their schema. A migration is data: a row of a table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.store import KeyedTable

#: Migrations that a table may hold: they go to all tasks.
MAX_MIGRATIONS = 512
FIRST = "1.0"
#: What a step does: op, a path of fields, and a value or the new path.
OPS = ("default", "set", "rename", "drop", "require")


class MigrationError(ValueError):
    pass


def version(text: str) -> tuple[int, int]:
    """major.minor as numbers; a third part is ignored."""
    parts = str(text).split(".")
    if len(parts) < 2 or not all(p.isdigit() for p in parts[:2]):
        raise MigrationError(f"no version: {text}")
    return int(parts[0]), int(parts[1])


def registry(migrations: DataFrame) -> dict[tuple[int, int], tuple[tuple[int, int], list[dict]]]:
    """from version to (to version, steps), of a table (from_version, to_version, steps as JSON)."""
    rows = migrations.limit(MAX_MIGRATIONS + 1).collect()
    if len(rows) > MAX_MIGRATIONS:
        raise MigrationError(f"over {MAX_MIGRATIONS} migrations")
    out: dict = {}
    for r in rows:
        steps = json.loads(r["steps"])
        if any(s["op"] not in OPS for s in steps):
            raise MigrationError(f"unknown step in the migration from {r['from_version']}")
        key, to = version(r["from_version"]), version(r["to_version"])
        if key in out:
            raise MigrationError(f"two migrations from {r['from_version']}")
        if to <= key:
            raise MigrationError(f"the migration from {r['from_version']} doesn't lead to a later version")
        out[key] = (to, steps)
    return out


def path(known: dict, start: tuple[int, int], target: tuple[int, int]) -> list[tuple[tuple[int, int], list[dict]]] | None:
    """The migrations from start to target in order; None if they don't lead there."""
    found, now = [], start
    while now < target:
        if now not in known:
            return None
        found.append(known[now])
        now = known[now][0]
    return found if now == target else None


def apply_steps(state: dict, steps: list[dict]) -> dict:
    """state with the steps applied to a copy. A path of which a part is there but no object, and a required or renamed field that isn't there, are errors."""
    state = json.loads(json.dumps(state))

    def parent(names: list[str], make: bool) -> dict | None:
        at = state
        for n in names[:-1]:
            if n not in at and not make:
                return None
            at = at.setdefault(n, {})
            if not isinstance(at, dict):
                raise MigrationError(f"{n} is no object")
        return at

    for s in steps:
        names = s["path"].split(".")
        at = parent(names, s["op"] in ("default", "set"))
        there = at is not None and names[-1] in at
        if s["op"] in ("require", "rename") and not there:
            raise MigrationError(f"{s['path']} is missing")
        if s["op"] == "set" or (s["op"] == "default" and not there):
            at[names[-1]] = s["value"]
        elif s["op"] == "drop" and there:
            del at[names[-1]]
        elif s["op"] == "rename":
            to = s["to"].split(".")
            value = at.pop(names[-1])
            parent(to, True)[to[-1]] = value
    return state


def migrate(states: DataFrame, migrations: DataFrame, target: str, at: datetime, key: str = "key", state: str = "state") -> DataFrame:
    """(key, state, outcome, from_version, error): every state (JSON) brought to the version target. outcome is migrated, already_current or failed; a failed
    state is as it was. A state without _schema_version is of version 1.0; a newer one, one without a path, one for which a step
    fails and text that is no object are failed. A migrated state bears its version and _migrated_at. Null and empty states are left out."""
    known, goal, stamp = registry(migrations), version(target), at.isoformat()
    paths: dict = {}

    def one(text: str) -> tuple[str, str, str | None, str | None]:
        own = None
        try:
            value = json.loads(text)
            if not isinstance(value, dict):
                raise MigrationError("no object")
            own = str(value.get("_schema_version", FIRST))
            now = version(own)
            if now == goal:
                return text, "already_current", own, None
            if now > goal:
                raise MigrationError(f"{own} is newer than {target}")
            if now not in paths:
                paths[now] = path(known, now, goal)
            if paths[now] is None:
                raise MigrationError(f"no path from {own} to {target}")
            for to, steps in paths[now]:
                value = apply_steps(value, steps) | {"_schema_version": f"{to[0]}.{to[1]}", "_migrated_at": stamp}
            return json.dumps(value, ensure_ascii=False, separators=(",", ":")), "migrated", own, None
        except (MigrationError, json.JSONDecodeError, KeyError, TypeError, AttributeError) as e:
            return text, "failed", own, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[i] for d in done], pa.string()) for i in range(4))], [key, state, "outcome", "from_version", "error"])

    rows = states.where(F.col(state).isNotNull() & ~F.trim(state).isin("", "{}")).select(key, state)
    return rows.mapInArrow(run, f"`{key}` {states.schema[key].dataType.simpleString()}, `{state}` string, outcome string, from_version string, error string")


def counts(migrated: DataFrame) -> DataFrame:
    """(outcome, n) of all three outcomes."""
    every = migrated.sparkSession.createDataFrame([("migrated",), ("already_current",), ("failed",)], "outcome string")
    return every.join(migrated.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def migrate_table(table: KeyedTable, migrations: DataFrame, target: str, at: datetime, like: str = "%", state: str = "state") -> DataFrame:
    """Migrates the states of the table whose keys match, and writes those that changed if no one else has changed them meanwhile. Returns
    (key, outcome): migrated, already_current, failed, or conflict."""
    rows = table.read().where(F.col(table.key).cast("string").like(like))
    done = migrate(rows, migrations, target, at, table.key, state)
    versions = rows.select(table.key, F.col("row_version").alias("expected"), *[c for c in table.schema.names if c not in (table.key, state)], F.col("expires_at"))
    left = (F.unix_micros("expires_at") - F.unix_micros(F.lit(at))) / 1e6
    changes = done.where("outcome = 'migrated'").select(table.key, state).join(versions, table.key).withColumn("ttl_seconds", left).drop("expires_at")
    written, _ = table.apply(changes, at)
    lost = written.where("outcome = 'conflict'").select(table.key, F.lit(True).alias("lost"))
    return done.select(table.key, "outcome").join(lost, table.key, "left").select(table.key, F.when(F.col("lost"), "conflict").otherwise(F.col("outcome")).alias("outcome"))
