"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without it (tests) gets a local folder, as its setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, prefix: str) -> str:
    return f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame, prefix: str = "step") -> DataFrame:
    """df as Parquet in a new shared folder, read back: it is computed once, and no executor's disk is needed later."""
    path = new_folder(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
