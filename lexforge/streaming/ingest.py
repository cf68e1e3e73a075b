"""Documents as a stream: each batch is merged incrementally, repeated contents are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.functions.text import content_id


def ingest(stream: DataFrame, path: str, checkpoint: str, time_col: str = "ts", delay: str = "1 day") -> StreamingQuery:
    """Appends documents of a stream (text, time) whose content was not seen within the delay."""
    fresh = stream.withColumn("content_id", content_id(F.col("text"))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_id"])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
