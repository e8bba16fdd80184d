"""Request logs as a stream: outcomes and latencies by window, with late rows bounded by a watermark.

The batch counterpart is a plain aggregation; both give the same rows once the stream has drained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def outcome_windows(log: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, outcome, n, total_ms) of a log with ts, event_type and value. State is a row for each
    open window and outcome; rows later than ``late`` are dropped, windows close behind the watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.sum("value").alias("total_ms"))
    return w.select(F.col("w.start").alias("window_start"), "outcome", "n", "total_ms")


def read_log(spark: SparkSession, path: str, schema: str | StructType = SCHEMA) -> DataFrame:
    """A folder of Parquet log files as a stream; new files are picked up as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all files that are there, appends closed windows to ``path`` and reads them."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
