"""State machines over ordered events, each a fold: budgets, task life cycles, autoscaling, circuit breakers, checkpoints and
replay of a semantic cache."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.operators.fold import fold


def admit(requests: DataFrame, daily: float, monthly: float, key: str = "cost_center", at: str = "at", identity: str = "id", amount: str = "amount") -> DataFrame:
    """requests with admitted, spent_day and spent_month (after the request): a request that brings a cost centre's day or month
    over its cap is refused and takes nothing. at is a timestamp; a null amount is refused."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        now, today, month = state
        day = row[at].date()
        if now is None or day != now:
            today, month = 0.0, month if now and (now.year, now.month) == (day.year, day.month) else 0.0
        fits = row[amount] is not None and today + row[amount] <= daily and month + row[amount] <= monthly
        if fits:
            today, month = today + row[amount], month + row[amount]
        return (day, today, month), {"admitted": fits, "spent_day": today, "spent_month": month}

    return fold(requests, [key], [at, identity], lambda: (None, 0.0, 0.0), step, "admitted boolean, spent_day double, spent_month double")


#: Status before, and what each event makes of it. Anything else is refused and changes nothing.
LIFE = {
    ("pending", "claim"): "running", ("retrying", "claim"): "running", ("running", "complete"): "completed", ("running", "pause"): "paused",
    ("paused", "resume"): "running", ("running", "return"): "pending",
}


def next_state(status: str, attempt: int, event: str, max_attempts: int) -> tuple[str, int] | None:
    """Status and attempt after an event; None if it is refused."""
    if status == "running" and event == "fail":
        new = "retrying" if attempt < max_attempts else "failed"
    else:
        new = LIFE.get((status, event))
    return None if new is None else (new, attempt + (event == "claim") - (event == "return"))


def life_cycle(events: DataFrame, max_attempts: int = 3, key: str = "task_id", at: str = "at", identity: str = "id", event: str = "event") -> DataFrame:
    """events with status (after the event), attempt and accepted. A task is pending at first; each claim is an attempt; a failure is
    retried until max_attempts are used up, then the task has failed. A task that was returned gets its attempt back."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        new = next_state(*state, row[event], max_attempts)
        now = new or state
        return now, {"status": now[0], "attempt": now[1], "accepted": new is not None}

    return fold(events, [key], [at, identity], lambda: ("pending", 0), step, "status string, attempt int, accepted boolean")


def compare_and_set(writes: DataFrame, key: str = "key", at: str = "at", identity: str = "id", expected: str = "expected") -> DataFrame:
    """writes with version (after the write) and written: a write counts if it expects the version that is there; a null one expects that
    nothing is. Each write that counts makes the next version, the first is 1."""

    def step(version: int, row: dict) -> tuple[int, dict]:
        fits = (row[expected] or 0) == version
        return version + fits, {"version": version + fits, "written": fits}

    return fold(writes, [key], [at, identity], lambda: 0, step, "version bigint, written boolean")


@dataclass(frozen=True)
class Scaling:
    least: int = 2
    most: int = 20
    up_depth: int = 50
    up_latency_ms: float = 2000.0
    down_depth: int = 10
    idle_buffer: int = 1
    up_step: int = 5
    down_step: int = 2
    up_cooldown: float = 60.0
    down_cooldown: float = 300.0
    per_worker: int = 10


def autoscale(metrics: DataFrame, rules: Scaling = Scaling(), key: str = "pool", at: str = "at") -> DataFrame:
    """metrics (pool, at in seconds, depth, latency_ms, idle) with change and workers (after it). Within a cooldown nothing changes."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        workers, up, down = state
        now, change = float(row[at]), 0
        if row["depth"] > rules.up_depth or row["latency_ms"] > rules.up_latency_ms:
            if now - up >= rules.up_cooldown and workers < rules.most:
                change = max(0, min(-(-row["depth"] // rules.per_worker) - workers, rules.most - workers, rules.up_step))
        elif workers > rules.least and row["depth"] < rules.down_depth and row["idle"] > rules.idle_buffer and now - down >= rules.down_cooldown:
            change = -max(0, min(row["idle"] - rules.idle_buffer, workers - rules.least, rules.down_step))
        up, down = (now, down) if change > 0 else (up, now) if change < 0 else (up, down)
        return (workers + change, up, down), {"change": change, "workers": workers + change}

    never = float("-inf")
    return fold(metrics, [key], [at], lambda: (rules.least, never, never), step, "change int, workers int")


def circuit_breaker(calls: DataFrame, threshold: int = 5, open_seconds: float = 60.0, key: str = "provider", at: str = "at", identity: str = "id", failed: str = "failed") -> DataFrame:
    """calls (provider, at in seconds, failed) with allowed and failures in a row. After threshold failures in a row calls are
    not allowed for open_seconds; the next one is tried, and a success closes the circuit. A refused call counts for nothing."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        run, until = state
        if row[at] < until:
            return state, {"allowed": False, "failures": run}
        run = run + 1 if row[failed] else 0
        return (run, row[at] + open_seconds if run >= threshold else float("-inf")), {"allowed": True, "failures": run}

    return fold(calls, [key], [at, identity], lambda: (0, float("-inf")), step, "allowed boolean, failures int")


def checkpoints(items: DataFrame, shortest: float, longest: float, threshold: float, window: int = 100, key: str = "task_id", at: str = "at", identity: str = "id", cost: str = "cost") -> DataFrame:
    """items (task_id, at in seconds, cost) with checkpoint: at the first item, and when an interval has passed since the last one that
    lies at a quarter between shortest and longest while the mean of the last window costs is over threshold, else at
    three quarters. shortest = longest is the strategy by time alone."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        last, costs, total = state
        mean = total / len(costs) if costs else None
        share = 0.5 if mean is None else 0.25 if mean > threshold else 0.75
        passed = None if last is None else row[at] - last
        now = passed is None or (passed >= shortest and (passed >= longest or passed >= shortest + (longest - shortest) * share))
        costs.append(row[cost])
        total += row[cost]
        if len(costs) > window:
            total -= costs.popleft()
        return (row[at] if now else last, costs, total), {"checkpoint": now}

    return fold(items, [key], [at, identity], lambda: (None, deque(), 0.0), step, "checkpoint boolean")


@dataclass(frozen=True)
class CacheRules:
    threshold: float = 0.95
    same: float = 0.99
    near_miss: float = 0.8
    ttl: float = 3600.0
    entries: int = 1000


def replay_semantic_cache(queries: DataFrame, rules: CacheRules = CacheRules(), key: str = "shard", at: str = "at", identity: str = "id", vector: str = "vector") -> DataFrame:
    """queries (shard, at in seconds, id, vector) with hit, similarity, matched (the entry's id) and near_miss, as a cache would have
    answered them in turn: a miss is stored, in place of an entry more alike than same; a full cache gives up the tenth of its
    entries with the fewest hits, oldest first. Entries older than ttl don't count. A null vector is a miss and isn't stored. The state is bounded by rules.entries."""

    class Cache:
        def __init__(self):
            self.v, self.ids, self.at, self.hits = [], [], [], []

        def keep(self, which: list[int]) -> None:
            for name in ("v", "ids", "at", "hits"):
                own = getattr(self, name)
                setattr(self, name, [own[i] for i in which])

    def step(c: Cache, row: dict) -> tuple[Cache, dict]:
        now = float(row[at])
        c.keep([i for i, t in enumerate(c.at) if t > now - rules.ttl])
        if row[vector] is None:
            return c, {"hit": False, "similarity": None, "matched": None, "near_miss": False}
        v = np.asarray(row[vector], float)
        v = v / (np.linalg.norm(v) or 1.0)
        alike = np.array(c.v) @ v if c.ids else np.zeros(0)
        best = int(alike.argmax()) if len(alike) else -1
        score = float(alike[best]) if len(alike) else None
        hit = score is not None and score >= rules.threshold
        out = {"hit": hit, "similarity": score, "matched": None if best < 0 else c.ids[best], "near_miss": not hit and score is not None and score >= rules.near_miss}
        if hit:
            c.hits[best] += 1
            return c, out
        twin = next((i for i, s in enumerate(alike) if s > rules.same), None)
        if twin is not None:
            c.v[twin], c.ids[twin], c.at[twin], c.hits[twin] = v, row[identity], now, 0
            return c, out
        if len(c.ids) >= rules.entries:
            order = sorted(range(len(c.ids)), key=lambda i: (c.hits[i], c.at[i]))
            c.keep(sorted(order[max(1, len(order) // 10) :]))
        for own, x in ((c.v, v), (c.ids, row[identity]), (c.at, now), (c.hits, 0)):
            own.append(x)
        return c, out

    return fold(queries, [key], [at, identity], Cache, step, f"hit boolean, similarity double, matched {queries.schema[identity].dataType.simpleString()}, near_miss boolean")
