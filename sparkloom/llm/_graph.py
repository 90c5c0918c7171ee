"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges (u, v); comp is the least node of its component.

    Each round takes the least label of the neighbours and then the label's own label, so that a chain is halved. The
    labels are written to the shared folder after each round; only a count comes to the driver.
    """
    both = durable(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), packed=True)
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("comp")), packed=True)
    while True:
        least = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(least.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        step = step.join(labels.select(F.col("node").alias("mid"), F.col("comp").alias("up")), "mid", "left")
        new = durable(step.select("node", "old", F.least("mid", "up").alias("comp")), packed=True)
        if not new.where("old <> comp").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
