"""Structured Streaming over event tables: windows, sessions, duplicates, and a polled folder.

Each function takes a streaming or static DataFrame with ``ts`` and returns a
DataFrame of the same kind, so a batch run checks a streaming one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet file or a folder of them as a stream; ``ts`` as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()  # a name may end in .parquet and be one
    got = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
    return with_timestamp(got)


def with_timestamp(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and window; later rows than ``late`` are dropped by a stream."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type")
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
    )


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a stream forgets keys after ``late``."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) kept in custom state and sent on with every change."""
    def step(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout"
    )


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all there is into a table in memory; for tests and small results."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    try:
        q.processAllAvailable()
        q.awaitTermination(600)
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def drain_to(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all there is into files below ``path``, written by the executors; for results of any size.

    A batch run again writes its own files again, so no row is there twice.
    """
    written = []

    def put(rows, batch):
        rows.write.mode("overwrite").parquet(to := f"{path}/{batch if mode == 'append' else 'all'}")
        if to not in written:
            written.append(to)

    writer = stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*written) if written else spark.createDataFrame([], stream.schema)


def incremental_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Appends rows with new keys only, batch by batch (K16): a batch run again adds nothing."""
    from glosswright.sources.io import append_new

    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
