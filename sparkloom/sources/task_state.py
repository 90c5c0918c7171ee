"""Source of task states: their schema, their check, and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "running", "paused", "completed", "failed")
TEXTS, TIMES = ("task_id", "task_type", "status", "payload", "checkpoint"), ("created_at", "updated_at", "completed_at")
SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in TEXTS), T.StructField("attempt_count", T.IntegerType()), *(T.StructField(n, T.TimestampType()) for n in TIMES), T.StructField("error_message", T.StringType())])


def valid() -> Column:
    """Whether a row meets the table's constraints: an id, one of the statuses, and a payload that is JSON."""
    status = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    return F.col("task_id").isNotNull() & status & F.try_parse_json(F.col("payload")).isNotNull()


def tasks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the constraints, with payload and checkpoint as variants, and those that don't, as they are."""
    ok = df.where(valid()).withColumns({c: F.try_parse_json(F.col(c)) for c in ("payload", "checkpoint")})
    return ok, df.where(~valid())


def read_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from Parquet. A filter on status is pushed into the scan."""
    return tasks(spark.read.schema(SCHEMA).parquet(path))


def key_ranges(column: str, bounds: str = "123456789abcdef") -> list[str]:
    """Conditions that share out the rows of a table by the first character of a text key, in standard SQL: each row, also one with a null key, meets exactly one
    of them, whatever the database's collation is."""
    cuts = list(bounds)
    parts = [f"{column} < '{cuts[0]}' OR {column} IS NULL", *(f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts[:-1], cuts[1:])), f"{column} >= '{cuts[-1]}'"]
    return [f"({p})" for p in parts]


def read_tasks_jdbc(spark: SparkSession, url: str, table: str = "task_state", key: str = "task_id", **options: str) -> tuple[DataFrame, DataFrame]:
    """The same from a database, read in ranges of the task's id. key is its name in the database's SQL."""
    df = spark.read.jdbc(url, table, predicates=key_ranges(key), properties=options)
    return tasks(df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]))
