"""Incremental ingest as a stream: late and repeated payloads become one keyed merge per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.latest import latest
from threadloom.operators.merge import SnapshotStore


def payload_stream(spark: SparkSession, path: str, schema: str, stamp: str, delay: str = "2 hours", files: int = 100) -> DataFrame:
    """JSON files as they arrive, with a watermark of the overlap that a scan re-reads, without exact repeats."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    timed = rows.withColumn("event_time", F.to_timestamp(F.col(stamp))).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["id", stamp])


def merge_stream(rows: DataFrame, store: SnapshotStore, name: str, keys: list[str], order: str, checkpoint: str, preserve: list[str] = ()) -> StreamingQuery:
    """Merge every micro-batch into the store, its newest row per key; a repeated batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        store.merge(name, latest(batch.drop("event_time"), keys, order), keys, preserve)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, stamp: str, kind: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per window and kind, final once the watermark has passed; works on streams and on tables."""
    return events.withWatermark(stamp, delay).groupBy(F.window(stamp, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")
