"""Micro-batch forms of the queue, idempotent appends and windowed counts (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import maintenance
from marlstone.sources import sinks


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts a tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    w = F.session_window(time_col, gap)
    return events.withWatermark(time_col, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, key: str, time_col: str, late: str = "1 day") -> DataFrame:
    """Rows of a key seen within the watermark pass once."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


QUEUE_SCHEMA = "key long, evidence long, status string, priority double, retries long"


def queue_writer(events: DataFrame, path: str, entities: DataFrame, checkpoint: str):
    """A query that folds each batch of (key, kind, at) into the tables ``path``/queue and ``path``/entities.

    ``entities`` (key, mention_count, retrieval_count) is where counting starts. A batch
    makes the version of its number from the newest version under that number, so a batch that is
    run again after a failure, at whatever point, gives the same two tables.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        queue = sinks.read_version(spark, f"{path}/queue", before=batch_id)
        known = sinks.read_version(spark, f"{path}/entities", before=batch_id)
        queue, known = maintenance.apply_events(spark.createDataFrame([], QUEUE_SCHEMA) if queue is None else queue, batch, entities if known is None else known)
        sinks.write_version(queue, f"{path}/queue", batch_id)
        sinks.write_version(known, f"{path}/entities", batch_id)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("update")


def append_writer(rows: DataFrame, path: str, key: str, checkpoint: str):
    """Idempotent appends: a key that is stored already is not stored again."""
    return rows.writeStream.foreachBatch(lambda batch, _: sinks.append_once(batch, path, key)).option("checkpointLocation", checkpoint)
