"""Job events (event_id, ts, user_id as job, event_type): history, retention, listings, and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events of a history page, and events kept.
PAGE, KEPT = 100, 1000


def history(events: DataFrame, job: int | None = None, types: list[str] | None = None, limit: int = PAGE) -> DataFrame:
    """The last events of a job or all, of some types or all, in order of time."""
    if job is not None:
        events = events.where(F.col("user_id") == job)
    if types:
        events = events.where(F.col("event_type").isin(*types))
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).orderBy("ts", "event_id")


def retain(events: DataFrame, most: int = KEPT) -> DataFrame:
    """The newest events overall."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def retain_each(events: DataFrame, most: int) -> DataFrame:
    """The newest events of each job."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def purge(events: DataFrame, job: int | None = None) -> DataFrame:
    """What is left after a job's history, or all of it, is cleared; events without a job are no job's."""
    return events.where(F.lit(False)) if job is None else events.where(~F.col("user_id").eqNullSafe(F.lit(job)))


def jobs(events: DataFrame) -> DataFrame:
    """Jobs with their last event, number of events, of purchases (steps) and errors (pending decisions)."""
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(
        F.max_by("event_type", last).alias("status"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "purchase").alias("n_steps"), F.count_if(F.col("event_type") == "error").alias("n_pending"),
    )


def newest_first(listing: DataFrame, limit: int = PAGE) -> DataFrame:
    return listing.orderBy(F.desc("last_ts"), "user_id").limit(limit)


def status_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy("status").agg(F.count("*").alias("n_jobs"))


def follow(spark: SparkSession, path: str, schema, job: int | None = None, types: list[str] | None = None, files_a_batch: int | None = None) -> DataFrame:
    """A stream of a folder's event files from the earliest on, of a job or all: replay, then what arrives."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)
    if job is not None:
        stream = stream.where(F.col("user_id") == job)
    return stream.where(F.col("event_type").isin(*types)) if types else stream


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write a stream to parquet exactly once; `once` ends when all that is there is written."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type in each window of time; works on tables and, with late data let in, on streams."""
    stream = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
