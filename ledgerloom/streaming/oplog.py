"""The change feed as a stream: micro-batches appended to a change log, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom import storage
from ledgerloom.operators.changelog import ChangeLog, outbox_changes


def read_outbox(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Deliveries as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow(feed: DataFrame, log: ChangeLog, checkpoint: str, compact: bool = True, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch to the log and compacts it as runs pile up.

    A batch that a failure makes Spark deliver again is skipped if a marker says that its run is complete; the
    marker is written after the run, and a run without marker adds the same changes again, which changes nothing.
    """
    spark = feed.sparkSession
    marks = f"{log.path}/batches"

    def step(batch: DataFrame, number: int) -> None:
        if storage.exists(spark, f"{marks}/{number}/_SUCCESS"):
            return
        log.append(outbox_changes(batch))
        if compact:
            log.compact()
        spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{number}")

    writer = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def op_counts(feed: DataFrame, delay: str = "10 days", window: str = "1 day") -> DataFrame:
    """Distinct ops by day of arrival and status, over a stream with late deliveries; each op_id counts once while the
    watermark holds it."""
    timed = feed.select("op_id", "status", F.try_to_timestamp("created_at").alias("at")).filter("at IS NOT NULL")
    once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["op_id"])
    return once.groupBy(F.window("at", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "status", "n")


def event_windows(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows; works on a stream or a table."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
