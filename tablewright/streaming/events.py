"""Follow the event log: files appended to it are picked up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_ready
from ..sources.events import EVENT_SCHEMA, status_counts


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New lines of the log as a stream; lines that are no JSON have no status and are left out."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).filter("status is not null")


def start_status_counts(
    events: DataFrame, name: str, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Keep the counts by status up to date in a table in memory; there are as many rows as statuses."""
    spark = events.sparkSession
    writer = (
        status_counts(events).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint or f"{checkpoint_ready(spark)}/{name}")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
