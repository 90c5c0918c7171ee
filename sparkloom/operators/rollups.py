"""Hourly rollups that can be merged: counts, sums, and quantile sketches (KLL), kept by hour and added to without reading events again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.folders import written
from sparkloom.sources.versions import VersionedFolder

#: Size of a sketch: a quantile's rank errs by about 1.65 % with 200, 0.33 % with 1000, for all quantiles with 99 % confidence.
SKETCH_K = 1000
RANK_ERROR = 0.0066  # twice that, for what is asserted


class HourlyRollups:
    """Rows (hour, metric, n, total, least, most, sketch) in versioned files, one folder a load. A load's hours may overlap those of others: rows of
    one hour are merged when they are read, and by compact()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, VersionedFolder(spark, path)

    def add(self, events: DataFrame, at: str, metric: str, value: str) -> dict:
        """Adds events. Those with a null time or value don't count; a null metric is a metric. Partial sketches are made before the shuffle."""
        parent = self.folder.manifest()
        known = events.where(F.col(at).isNotNull() & F.col(value).isNotNull())
        v = F.col(value).cast("double")
        rows = known.groupBy(F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour"), F.col(metric).alias("metric")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch")
        )
        out = rows.withColumn("day", F.to_date("hour"))
        return self.folder.commit(parent["version"], {"loads": [*parent.get("loads", []), self.folder.written(out, "day")]})

    def _rows(self, version: int | None = None) -> DataFrame | None:
        schema = "hour timestamp, metric string, n bigint, total double, least double, most double, sketch binary, day date"
        rows = None
        for load in self.folder.manifest(version).get("loads", []):
            own = self.spark.read.schema(schema).parquet(load)
            rows = own if rows is None else rows.unionByName(own)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def hours(self, version: int | None = None) -> DataFrame:
        """The rollup of each hour and metric."""
        return self._merged(self._rows(version), ["hour", "metric", "day"])

    @staticmethod
    def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))

    def report(self, start: str | None = None, end: str | None = None, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
        """(metric, n, mean, least, most, p50, ...) over the hours from start up to end; only their days' folders are read. A quantile's
        rank is right within RANK_ERROR."""
        rows = self._rows()
        for bound, op in ((start, "__ge__"), (end, "__lt__")):
            if bound is not None:
                rows = rows.where(getattr(F.col("hour"), op)(F.lit(bound).cast("timestamp")))
        if start is not None:
            rows = rows.where(F.col("day") >= F.to_date(F.lit(start)))
        if end is not None:
            rows = rows.where(F.col("day") <= F.to_date(F.lit(end)))
        found = self._merged(rows, ["metric"])
        names = [f"p{round(q * 1000) / 10:g}".replace(".", "_") for q in quantiles]
        ask = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(n) for q, n in zip(quantiles, names)]
        return found.select("metric", "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", *ask)

    def compact(self) -> dict:
        """All loads as one."""
        parent = self.folder.manifest()
        if len(parent.get("loads", [])) < 2:
            return parent
        return self.folder.commit(parent["version"], {"loads": [self.folder.written(written(self.hours()), "day")]})

    def keep_since(self, hour: str) -> dict:
        """Drops the hours before the given one: the retention of a rollup."""
        parent = self.folder.manifest()
        kept = self.hours().where(F.col("hour") >= F.lit(hour).cast("timestamp"))
        return self.folder.commit(parent["version"], {"loads": [self.folder.written(written(kept), "day")]})
