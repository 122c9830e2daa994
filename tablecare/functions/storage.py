"""Tables between steps: written in the folder that driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: later steps start from it, also after lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, mode: str = "error") -> tuple[DataFrame, int]:
    """Write a table and read it back; with it the number of its rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark's own, for small files and names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables made by materialize() or written() that nothing needs any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, place = file_system(df.sparkSession, folder)
            fs.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it is not there."""
    fs, place = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all."""
    fs, place = file_system(spark, path)
    _, draft = file_system(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, place):
        raise OSError(f"{path} could not be put in place")


def get(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
