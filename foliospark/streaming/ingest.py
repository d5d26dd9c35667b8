"""Incremental ingest: the same stateless operators on file streams, and running aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of image files as they arrive."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").option("recursiveFileLookup", "true").load(path)


def running_confusion(pairs: DataFrame, time: str, truth: str, prediction: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Confusion counts by time window of a stream of predictions; rows later than ``late`` are dropped by the watermark."""
    t, p = F.col(truth).cast("boolean"), F.col(prediction).cast("boolean")
    counts = [F.count("*").alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]
    rows = pairs.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(*counts)
    return rows.select(F.col("w.start").alias("start"), "total", "tp", "tn", "fp", "fn")


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total of events (ts, event_type, value) by tumbling window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """All data there is, through to an in-memory table ``name``."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
