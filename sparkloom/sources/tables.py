"""Table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Name to DataFrame, read when asked for."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt out if it is read in fewer partitions than there are cores, as a table of one row group is; such a table is
    small. All others stay as they are, and so do those that come out of a shuffle: to count their partitions would run them."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
