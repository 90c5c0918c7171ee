"""Merging states: change tables, last write wins, additive merge and vector clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Partial aggregation: a key's rows are never in one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def apply_changes(base: DataFrame, changes: DataFrame, key: str, op: str = "op", seq: str = "seq") -> DataFrame:
    """base after changes (key, op, seq and all columns of base): the last change of a key counts. op is upsert or delete; to delete
    a key that isn't there does nothing. Keys of base are unique."""
    rest = [c for c in base.columns if c != key]
    last = latest(changes.select(key, op, seq, *rest), [key], [seq]).select(key, F.col(op).alias("__op"), *[F.col(c).alias(f"__{c}") for c in rest])
    both = base.withColumn("__old", F.lit(True)).join(last, key, "full")
    kept = both.where(F.coalesce(F.col("__op") == "upsert", F.col("__old"), F.lit(False)))
    return kept.select(key, *[F.when(F.col("__op") == "upsert", F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in rest]).select(*base.columns)


def clock_order(a: Column, b: Column) -> Column:
    """equal, a, b (which of the clocks is at least the other everywhere) or concurrent. Clocks are maps; what is missing is 0."""
    empty = F.create_map().cast("map<string,bigint>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    over = lambda x, y: F.forall(keys, lambda k: at(x, k) >= at(y, k))
    return F.when(over(a, b) & over(b, a), "equal").when(over(a, b), "a").when(over(b, a), "b").otherwise("concurrent")


def merged_clock(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def additive(a: Column, b: Column) -> Column:
    """Maps of numbers added up by key. Keys that begin with _ are b's, unless b has none or 0; a key of one side keeps its value."""

    def one(k: Column, x: Column, y: Column) -> Column:
        of_b = F.when(F.coalesce(y, F.lit(0)) != 0, y).otherwise(F.coalesce(x, y))
        return F.when(F.startswith(k, F.lit("_")), of_b).when(x.isNotNull() & y.isNotNull(), x + y).otherwise(F.coalesce(x, y))

    return F.map_zip_with(a, b, one)


def union_lists(a: Column, b: Column) -> Column:
    """Elements of both in order, the first of equal ones."""
    return F.array_distinct(F.concat(a, b))


def merge_states(pairs: DataFrame) -> DataFrame:
    """pairs (..., clock_a, clock_b, state_a, state_b) with relation, clock, state and conflict: the state of the clock that dominates, a's
    of equal clocks; concurrent states are added up and their clocks joined."""
    both = pairs.withColumn("relation", clock_order(F.col("clock_a"), F.col("clock_b")))
    clash, of_b = F.col("relation") == "concurrent", F.col("relation") == "b"
    pick = lambda name, merged: F.when(clash, merged).when(of_b, F.col(f"{name}_b")).otherwise(F.col(f"{name}_a"))
    return both.withColumns({"clock": pick("clock", merged_clock(F.col("clock_a"), F.col("clock_b"))), "state": pick("state", additive(F.col("state_a"), F.col("state_b"))), "conflict": clash})
