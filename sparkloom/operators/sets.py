"""Joins of rows by the sets that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.folders import written


def fingerprints(items: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, n, low, high) of each key's set of parts (rows of items): the number of different ones and 128 bits that don't depend on their order.
    State is three numbers a key, whatever the size of the set."""
    distinct = items.select(key, *parts).distinct()
    bits = [F.xxhash64(F.lit(i), *[F.struct(F.col(p).isNull(), F.col(p)) for p in parts]) for i in (1, 2)]
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bits[0]).alias("low"), F.bit_xor(bits[1]).alias("high"))


def duplicate_requests(requests: DataFrame, items: DataFrame, parts: list[str], within: str = "0.01") -> DataFrame:
    """(id, duplicate_of): for each of requests (id, requester, total, place) the first other one by place of the same requester, whose items (id, and
    parts) are the same set and whose total differs by less than within; requests without one are left out. place is an
    identity. Totals are taken with four decimals. A request without items has the empty set.

    Sets meet by fingerprint. In a group of equal fingerprints only different totals meet, each with those of its own and the two neighbouring
    steps of within, at most 3 * within * 10,000 of them, and carries its two first requests; so a group of any number of equal requests makes a row each. The found pairs
    are then held against each other item by item; a pair whose sets differ after all (a collision of 128 bits) is an error.
    """
    units = round(float(within) * 10_000)
    own = requests.join(fingerprints(items, "id", parts), "id", "left")
    own = own.select("id", "requester", "place", F.round(F.col("total").cast("decimal(38,6)") * 10_000).cast("long").alias("total"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "low", "high")])
    own = written(own)  # the steps below read it four times, and firsts and met as often
    group = ["requester", "n", "low", "high"]
    entry = F.struct("place", "id")
    firsts = own.where("requester IS NOT NULL AND total IS NOT NULL").groupBy(*group, "total").agg(F.min(entry).alias("a"), F.count(F.lit(1)).alias("k"))
    second = own.join(firsts.where("k > 1"), [*group, "total"]).where(F.struct("place", "id") != F.col("a")).groupBy(*group, "total").agg(F.min(entry).alias("b"))
    firsts = firsts.join(second, [*group, "total"], "left").withColumn("step", F.floor(F.col("total") / units))
    firsts = written(firsts)
    other = firsts.select(*group, F.col("total").alias("near"), F.explode(F.array(*[F.col("step") + i for i in (-1, 0, 1)])).alias("step"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = firsts.join(other, [*group, "step"]).where(F.abs(F.col("total") - F.col("near")) < units)
    entries = written(met.select(*group, "total", F.explode(F.array("c", "d")).alias("e")).where("e IS NOT NULL"))
    two = entries.groupBy(*group, "total").agg(F.min("e").alias("a"))
    rest = entries.join(two, [*group, "total"]).where("e <> a").groupBy(*group, "total").agg(F.min("e").alias("b"))
    two = two.join(rest, [*group, "total"], "left")
    found = own.join(two, [*group, "total"]).select("id", F.when(F.col("a.id") == F.col("id"), F.col("b.id")).otherwise(F.col("a.id")).alias("duplicate_of"), "n").where("duplicate_of IS NOT NULL")
    found = written(found)
    sets = items.select("id", *parts).distinct()
    same = [F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}")) for p in parts]
    left = found.join(sets.alias("l"), "id").select("id", "duplicate_of", *[f"l.{p}" for p in parts]).alias("l")
    cond = F.col("l.duplicate_of") == F.col("r.id")
    for s in same:
        cond = cond & s
    shared = left.join(sets.alias("r"), cond).groupBy(F.col("l.id").alias("id")).agg(F.count(F.lit(1)).alias("shared"))
    checked = found.join(shared, "id", "left").withColumn("fine", F.coalesce("shared", F.lit(0)) == F.col("n"))
    return checked.select("id", F.when(F.col("fine"), F.col("duplicate_of")).otherwise(F.raise_error(F.lit("two different sets have one fingerprint")).cast("string").cast(found.schema["duplicate_of"].dataType)).alias("duplicate_of"))
