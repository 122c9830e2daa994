"""Stored results of event streams: history, retained events and job listings in buckets by job, each batch's work done once.

A batch that runs again after a failure finds the same batch number and the same state, so every sink here writes what a
batch stands for over what an earlier attempt may have left: history by batch number, listings and retained events by job.
Tables are partitioned by buckets of jobs, and only buckets that a batch or a purge touches are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cells import free
from . import events

#: Buckets that jobs are dealt to, and how late an event may come, or come again, after the newest.
BUCKETS, LATE = 16, "2 days"


def bucket(job: str = "user_id", buckets: int = BUCKETS) -> Column:
    """A job's bucket; null is a job like others."""
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


def once(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each event of a stream once, by event_id, however often files repeat it within the time that events may be late."""
    at, = free(stream, "_at")  # a time of the kind that watermarks take
    return stream.withColumn(at, F.col("ts").cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["event_id"]).drop(at)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start a stream into a sink of batches; available_now ends with what is there, else it follows."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def history_sink(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Adds a batch's events to a history; its files stand under the batch's number and replace those of an attempt that failed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("bucket", bucket(buckets=buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return write


def history(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events of a stored history, with the columns of schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def purge(spark: SparkSession, path: str, schema, job: int | None) -> int:
    """Delete a job's events from a stored history; returns how many. Only files of its bucket in batches that have it are written again."""
    stored = spark.read.schema(f"{_ddl(schema)}, batch long, bucket int").option("basePath", path).parquet(path)
    own = stored.where(F.col("bucket") == _bucket_of(spark, job, schema))
    left = own.groupBy("batch", "bucket").agg(F.count("*").alias("n"), F.count_if(~F.col("user_id").eqNullSafe(F.lit(job))).alias("left"))
    touched = left.where("left < n").collect()  # a row for each batch that has the job
    for r in touched:
        if not r.left:  # a partition without rows would be left as it is
            _delete(spark, f"{path}/batch={r.batch}/bucket={r.bucket}")
    rewrite = [r.batch for r in touched if r.left]
    if rewrite:
        rows = own.where(F.col("batch").isin(rewrite)).where(~F.col("user_id").eqNullSafe(F.lit(job)))
        _overwrite(rows, path, ["batch", "bucket"])
    return sum(r.n - r.left for r in touched)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _bucket_of(spark: SparkSession, job: int | None, schema, buckets: int = BUCKETS) -> int:
    kind = schema["user_id"].dataType
    return spark.range(1).select(F.lit(job).cast(kind).alias("user_id")).select(bucket(buckets=buckets)).first()[0]


def _overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write partitions over those of a stored table that have the same values; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert_sink(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Puts a batch's rows, one for each job (user_id), in the place of those jobs' rows in a stored table."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", bucket(buckets=buckets)).persist()
        try:
            rows = fresh
            if _exists(spark, path):
                stored = spark.read.schema(fresh.schema).parquet(path)
                near = stored.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")  # BUCKETS rows at most
                kept = near.alias("a").join(fresh.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.user_id").eqNullSafe(F.col("b.user_id")), "left_anti")
                rows = fresh.unionByName(kept)
            _overwrite(rows, path, ["bucket"])
        finally:
            fresh.unpersist()

    return write


def follow_jobs(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The job listing of a stream as a stored table, kept up to date: only jobs with new events are written, in their buckets."""
    return run(events.jobs(stream), upsert_sink(path), checkpoint, "update", available_now)


def listing(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored job listing."""
    return spark.read.schema(schema).parquet(path).drop("bucket")


#: The state and output of a job: its newest events.
_KEPT = "ids array<long>, times array<{time}>, types array<string>"


def retained(stream: DataFrame, most: int) -> DataFrame:
    """user_id, ids, times, types: for each job with new events the newest `most` it ever had, newest first (ties: the larger event_id).

    The state of a job is a ring of at most `most` events, whatever the length of its history. Null is a job like others.
    """
    job, kept_ = stream.schema["user_id"].dataType.simpleString(), _KEPT.format(time=stream.schema["ts"].dataType.simpleString())

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            held += list(zip(part["event_id"].tolist(), part["ts"].tolist(), part["event_type"].tolist(), strict=True))
            held = sorted(held, key=lambda e: (e[1], e[0]), reverse=True)[:most]
        columns = [list(c) for c in zip(*held, strict=True)]
        state.update(tuple(columns))
        yield pd.DataFrame({"user_id": [key[0]], "ids": [columns[0]], "times": [columns[1]], "types": [columns[2]]})

    grouped = stream.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return grouped.applyInPandasWithState(work, f"user_id {job}, {kept_}", kept_, "update", GroupStateTimeout.NoTimeout)


def retain(stream: DataFrame, most: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest events of each job of a stream in a stored table."""
    return run(retained(stream, most), upsert_sink(path), checkpoint, "update", available_now)


def kept(spark: SparkSession, path: str, schema) -> DataFrame:
    """event_id, ts, user_id, event_type of a table of retained events; schema is that of the events."""
    job, time = (schema[c].dataType.simpleString() for c in ("user_id", "ts"))
    stored = spark.read.schema(f"user_id {job}, {_KEPT.format(time=time)}").parquet(path)
    each = F.inline(F.arrays_zip(F.col("ids").alias("event_id"), F.col("times").alias("ts"), F.col("types").alias("event_type")))
    return stored.select("user_id", each).select("event_id", "ts", "user_id", "event_type")
