"""Streams whose results don't pass through the driver."""

from pyspark.sql import functions as F

from glosswright.plans import table_queries
from glosswright.streaming import events as stream


def test_streamed_queries_use_no_table_in_memory(spark, monkeypatch, tmp_path):
    def memory(*a, **k):
        raise MemoryError("a table in the driver's memory")

    monkeypatch.setattr(stream, "drain", memory)
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 977).alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), F.lit(1.0).alias("value"),
    )
    rows.repartition(40).write.parquet(str(tmp_path / "events.parquet"))
    # 40 files are three batches: what one wrote before isn't there twice
    assert table_queries.stream_session(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 400
    assert table_queries.stream_tumbling(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 400
    got = table_queries.stream_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(set(got)) == 15
