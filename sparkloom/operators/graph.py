"""Dependency graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.folders import written


#: A round takes nodes off only if it takes a share of 1 / SHRINK of the edges with it, so there are few rounds.
SHRINK = 5


def _rounds(edges: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """(root, node) by rounds. Each joins only the nodes that the last one found, so a cycle ends; what it finds is written once."""
    new = written(roots.select(F.col("key").alias("root"), F.col("key").alias("node")).distinct())
    rounds = [new]
    while True:
        near = new.join(edges, F.col("node") == F.col("key")).select("root", F.col("dependent").alias("node")).distinct()
        found = reduce(DataFrame.unionByName, rounds)
        new = written(near.join(found, ["root", "node"], "left_anti"))
        if new.isEmpty():
            return rounds
        rounds.append(new)


def cascade(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): all transitive dependents of each root over edges (key, dependent), the root included.

    Keys that nothing leads to are taken off layer by layer, while that shrinks the graph; what is left, cycles among it, is searched in rounds. Then the layers
    come back, the last one first: what a key leads to is itself, its dependents, and what was found for them. So each pair is made once for each edge that
    leads to it, and not held against all pairs found so far. If less than half of the keys are roots, or the graph has no such layers, there are rounds only.
    """
    edges = written(edges.select("key", "dependent").where("key IS NOT NULL").distinct())
    roots = written(roots.select("key").distinct())
    keys = edges.select("key").distinct()
    other = keys.join(roots, "key", "left_anti").count()  # keys that are no roots: their pairs would be made for nothing
    layers: list[DataFrame] = []
    left, n = edges, edges.count()
    while n and other <= roots.count():
        free = left.join(left.select(F.col("dependent").alias("key")).distinct(), "key", "left_anti")
        layer = written(free)
        gone = layer.count()
        if gone * SHRINK < n:
            break
        layers.append(layer)
        left = written(left.join(layer.select("key").distinct(), "key", "left_anti"))
        n -= gone
    inner = left.select("key").distinct() if layers else roots
    parts = _rounds(left, inner)
    for layer in reversed(layers):
        found = reduce(DataFrame.unionByName, parts)
        below = layer.join(found.hint("shuffle_merge"), F.col("dependent") == F.col("root")).select(F.col("key").alias("root"), "node")
        own = layer.select(F.col("key").alias("root"), F.explode(F.array("key", "dependent")).alias("node"))
        parts.append(written(below.unionByName(own).distinct()))
    found = reduce(DataFrame.unionByName, parts)
    if not layers:
        return found
    alone = roots.join(keys, "key", "left_anti").select(F.col("key").alias("root"), F.col("key").alias("node"))
    return (found.join(roots.select(F.col("key").alias("root")), "root", "left_semi") if other else found).unionByName(alone)
