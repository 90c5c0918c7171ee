"""Exact order statistics of groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.folders import written

#: Rows of a group are looked for this far from the share asked for; the sketch below errs by a tenth of that at most.
NEAR, ACCURACY = 0.002, 5000
#: A group of fewer rows, in which NEAR is less than four rows, is sorted whole.
SMALL = 2000


def kth(df: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(by, n, and a column for each name wanted): name to (share, place), where place(n) is the value's number from 0 in the
    group's order, within a row or two of share * n. Null values don't count.

    A first pass makes a sketch, which gives bounds around each share. A second one counts, for all names at once, what lies below a name's
    bounds and how often each value between them is there; only these counts, of different values in the band, are put in
    order. A place outside its band, which the sketch's error bound rules out, is an error."""
    rows = df.where(F.col(value).isNotNull()).select(by, value)
    shares = [s for s, _ in wanted.values()]
    ask = [max(0.0, s - NEAR) for s in shares] + [min(1.0, s + NEAR) for s in shares]
    sketch = F.percentile_approx(value, F.array(*[F.lit(a) for a in ask]), F.lit(ACCURACY))
    bounds = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("b")))
    few = F.col("n") < SMALL
    bands = [
        F.struct(F.lit(i).alias("i"), F.when(few, F.lit(float("-inf"))).otherwise(F.col("b")[i]).alias("low"), F.when(few, F.lit(float("nan"))).otherwise(F.col("b")[i + len(shares)]).alias("high"))
        for i in range(len(shares))  # nan is over all others
    ]
    small = bounds.select(F.col(by).alias("__by"), F.array(*bands).alias("bands"))
    joined = rows.join(F.broadcast(small) if bounds.count() <= 10_000 else small, F.col(by).eqNullSafe(F.col("__by")))
    each = joined.select(by, F.col(value).alias("v"), F.explode("bands").alias("band")).where((F.col("v") <= F.col("band.high")) | (F.col("v") < F.col("band.low")))
    key = F.when(F.col("v") >= F.col("band.low"), F.col("v"))  # null: below the band
    counts = each.groupBy(by, F.col("band.i").alias("i"), key.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up_to = F.sum("c").over(W.partitionBy(by, "i").orderBy(F.col("v").asc_nulls_first()))
    placed = counts.withColumn("up_to", up_to).join(bounds.select(F.col(by).alias("__by"), "n"), F.col(by).eqNullSafe(F.col("__by")))
    place = F.coalesce(*[F.when(F.col("i") == i, p(F.col("n"))) for i, (_, p) in enumerate(wanted.values())])
    hit = placed.where(F.col("up_to") > place).groupBy(by, "i").agg(F.min(F.struct("up_to", "v")).alias("h"))
    names = hit.groupBy(by).agg(*[F.max(F.when(F.col("i") == i, F.col("h"))).alias(n) for i, n in enumerate(wanted)])
    # n comes with the bounds: a group whose place is missing fails here.
    out = bounds.select(by, "n").withColumnRenamed(by, "__by").join(names, F.col("__by").eqNullSafe(F.col(by)), "left")
    wrong = F.raise_error(F.lit("a place lies outside its band")).cast(rows.schema[value].dataType)
    return out.select(F.col("__by").alias(by), "n", *[F.when(F.col(n)["v"].isNull(), wrong).otherwise(F.col(n)["v"]).alias(n) for n in wanted])
