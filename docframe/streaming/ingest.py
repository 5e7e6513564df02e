"""Append-only ingestion with Structured Streaming.

A file stream sees new files only; modified and deleted ones need a table's refresh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_json(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of (doc, _file) from new JSON files."""
    lines = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.json").format("text").load(directory)
    return lines.select(F.try_parse_json("value").alias("doc"), F.col("_metadata.file_name").alias("_file"))


def ingest_table(rows: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, as far as there is input now."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(partition_by) if partition_by else writer).trigger(availableNow=True).start()


def watch_changes(rows: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call on_batch with each micro-batch: the streaming form of put hooks."""
    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
