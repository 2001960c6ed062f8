"""Resumable ingestion and event-time windows on Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream with `ts` as an instant, as watermarks need it."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: How much later, in event time, an event may come again: what the state keeps.
LATE = "3650 days"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_new(stream: DataFrame, done_path: str, key: list[str], checkpoint: str, late: str = LATE) -> list[dict]:
    """Append the rows whose key was not met before to a Parquet folder, until the input is used up; returns the progress of each batch.

    The keys met are state, in a store on disk that is saved with the checkpoint: a batch reads no history. A batch that runs again starts from
    the state before it, and the folder's log names the files of each finished batch once, so restarts are exact. A key is kept until the
    watermark, `late` behind the latest event, has passed its event; rows later than that are left out, and so a repeat can't come after it.
    So the state holds the keys of the last `late` of event time.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        fresh = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
        query = fresh.writeStream.outputMode("append").format("parquet").option("path", done_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress]


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts by day and type; rows later than `late` are left out, and state is dropped after that."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to a Parquet folder until the input is used up."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
