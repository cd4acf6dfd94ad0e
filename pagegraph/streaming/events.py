"""Streaming over event files: URLs seen first, and totals per host in time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.storage import shared_dir


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(events: DataFrame, time: str, within: str) -> DataFrame:
    """Events whose URL was not seen within a span of event time; the state is bounded by the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["url"])


def host_windows(events: DataFrame, time: str, late: str, width: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), "host").agg(F.count("*").alias("n"), F.sum("bytes_read").alias("bytes"))


def sink(stream: DataFrame, name: str, path: str) -> None:
    """Runs a stream over what is there now and appends it to Parquet; its checkpoint is in the shared folder."""
    place = f"{shared_dir(stream.sparkSession)}/pagegraph/streams/{name}"
    stream.writeStream.format("parquet").option("checkpointLocation", place).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
