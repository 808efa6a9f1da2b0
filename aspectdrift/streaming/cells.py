"""Cells of quads or events kept up to date by a stream: sums by time window and keys, late rows until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, keys..., n, total) a window; state is bounded by the watermark."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_available(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all there is, then stop; the result is the in-memory table `name`."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
