"""Incremental exact deduplication of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, group: Column, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each group key within the watermark; state is dropped behind it."""
    return stream.withColumn("group_key", group).withWatermark(time, late).dropDuplicatesWithinWatermark(["group_key"])


def counts(stream: DataFrame, by: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by class in tumbling windows."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended as Parquet; the checkpoint folder makes a restart go on where it was."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
