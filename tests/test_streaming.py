"""The event stream is read to its end, however long its batch takes."""

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.streaming.counters import hourly_counters
from tests.conftest import DATA


def test_slow_stream_is_awaited(spark, monkeypatch):
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else wait(self, 0.001))
    got = hourly_counters(spark, f"{DATA}/events.parquet").agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_empty_stream(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").where("false").write.parquet(str(tmp_path / "events.parquet"))
    assert hourly_counters(spark, str(tmp_path / "events.parquet")).count() == 0
