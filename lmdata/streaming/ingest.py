"""Streaming ingestion: append-only records and log lines, each exactly once, and windowed sums of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lmdata.operators.sweeps import loss_lines


def records(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """JSON lines as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """A trainer's output lines as (iter, kind, loss)."""
    return loss_lines(spark.readStream.text(folder).select(F.col("value").alias("line")))


def append(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, at: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends what has come, then stops.  With ``keys`` a key is kept once; with a time column, once within ``late``, so that state stays bounded."""
    if keys and at:
        stream = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    elif keys:
        stream = stream.dropDuplicates(keys)
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def window_sums(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: events per window and type; the same on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def progress(df: DataFrame, name: str, **metrics) -> DataFrame:
    """Adds metrics that a listener gets for each batch or run."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
