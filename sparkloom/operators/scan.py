"""Running sums over ordered rows, also of groups that hold most of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.folders import written


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: the sum over the rows of its group up to and with it. order ends in an identity.

    The table is cut into ranges of (by, order), and a group of any size lies in as many as it fills. Each range's sums by group
    are added up over the ranges before it, which are as many rows as there are ranges and groups; inside a range rows are summed
    by a window of (range, group). So no task sees more than a range, and ranges are even. Null values count as 0; a null key is a group.
    """
    keys = [F.col(c) for c in by]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    values = {n: F.coalesce(v, F.lit(0)) for n, v in sums.items()}
    numbered = df.withColumns({f"__o{i}": c for i, c in enumerate(order)}).withColumns({f"__v_{n}": v for n, v in values.items()})
    names = [f"__o{i}" for i in range(len(order))]
    cut = numbered.repartitionByRange(*keys, *names) if by or names else numbered
    rows = written(cut.withColumn("__range", F.spark_partition_id()))
    total = rows.groupBy("__range", *by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ahead = total.select("__range", *by, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    ahead = ahead.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k_{c}") for c in by], *[f"__b_{n}" for n in sums])
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = W.partitionBy("__range", *keys).orderBy(*names).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = rows.join(ahead, same)
    return joined.select(*df.columns, *[(F.sum(f"__v_{n}").over(inside) + F.col(f"__b_{n}")).alias(n) for n in sums])


def position(df: DataFrame, by: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """df with each row's number in its group, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("long")})


def keep_all_but_lowest(df: DataFrame, order: list[str | Column], share: int = 10, least: int = 1) -> DataFrame:
    """df without its first max(least, n // share) rows in order: LFU with (hits, created), LRU with (last used)."""
    n = df.count()
    return position(df, [], order, "__place").where(F.col("__place") > max(least, n // share)).drop("__place")
