"""Row numbers of files: 0, 1, 2, ... over many files in the order in which they are named, without a sort.

Spark reads a file in blocks, packs blocks into partitions by size, and reads each block's rows in file order. So a
row's number is the number of rows in earlier files, and in earlier blocks of its own file, plus its place in its block.
One pass counts the rows of each block and notes where the block stands in its partition; the counts, a row for each
block, are summed up in order; and each row finds its block's sum by the place from which it was read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialize

#: What a file's address begins with where it names no host: written with one slash or three.
_NO_HOST = r"^([A-Za-z0-9+.-]+):///"
#: Files whose rows are summed up in one task.
FILES_AT_ONCE = 4096
#: Blocks whose sums are sent to all executors (under 100 MB); with more, rows and sums are joined by shuffle.
MOST_BLOCKS = 1 << 20


def ordered_files(df: DataFrame, paths: list[str]) -> list[str]:
    """The files of a table read from paths (files, folders or patterns): by the first path that holds them, then by name."""
    spark = df.sparkSession
    plain = lambda uri: re.sub(_NO_HOST, r"\1:/", uri)
    place: dict[str, int] = {}
    for i, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
            place.setdefault(plain(status.getPath().toUri().toString()), i)

    def first(file: str) -> int:
        at = file
        while at not in place and "/" in at:
            at = at.rpartition("/")[0]
        return place.get(at, len(paths))

    return sorted(set(map(plain, df.inputFiles())), key=lambda f: (first(f), f))


def number_rows(df: DataFrame, paths: list[str], name: str, kind: str = "csv") -> DataFrame:
    """df, a table just read from files, with the number of each row in the order of paths as a column.

    The files are read once to count. Text is numbered by blocks: if files or the settings that cut them into blocks
    change before the table is used, it raises. Parquet knows the place of a row in its file and has no such bond.
    """
    if len(set(paths)) < len(paths):
        raise ValueError("a path is named twice")
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    file, block, part, at, before, first, rows = (prefix + n for n in ("file", "block", "part", "at", "before", "first", "rows"))
    key = [file, block, part]
    if kind == "parquet":
        places = {block: F.lit(0).cast("long"), part: F.lit(0), at: F.col("_metadata.row_index")}
    else:
        places = {block: F.col("_metadata.file_block_start"), part: F.spark_partition_id(), at: F.monotonically_increasing_id()}
    marked = df.select("*", F.xxhash64("_metadata.file_path").alias(file), *[c.alias(n) for n, c in places.items()])
    known = F.count(F.col(f"`{df.columns[0]}`")).alias("seen") if df.columns else F.lit(0).alias("seen")  # so that rows are parsed as they will be read
    path = prefix + "path"
    blocks = materialize(df.select("*", F.regexp_replace("_metadata.file_path", _NO_HOST, "$1:/").alias(path), F.xxhash64("_metadata.file_path").alias(file), *[c.alias(n) for n, c in places.items()]).groupBy(*key, F.col(path).alias("path")).agg(F.count("*").alias(rows), F.min(at).alias(first), known), "blocks")
    starts = materialize(_starts(blocks, ordered_files(df, paths), key, rows, first, before), "starts")
    starts = F.broadcast(starts) if starts.count() <= MOST_BLOCKS else starts
    place = F.col(at) - F.col(first)
    number = F.when(place.between(0, F.col(rows) - 1), F.col(before) + place).otherwise(F.raise_error("files are cut into other blocks than when their rows were counted: read the table again").cast("long"))
    return marked.join(starts, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


def _starts(blocks: DataFrame, files: list[str], key: list[str], rows: str, first: str, before: str) -> DataFrame:
    """Each block's key, first place, rows, and the rows before it. No task sees more than one file's blocks, a group of files or one row a group."""
    numbered = blocks.sparkSession.createDataFrame([(f, i, i // FILES_AT_ONCE) for i, f in enumerate(files)], "path string, number long, batch long")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = blocks.withColumn("n", F.col(rows)).join(numbered, "path", "left")
    totals = held.groupBy("number", "batch").agg(F.sum("n").alias("n"))
    batches = totals.groupBy("batch").agg(F.sum("n").alias("n")).withColumn("in_batches", earlier(W.orderBy("batch"))).select("batch", "in_batches")
    of_file = totals.withColumn("in_files", earlier(W.partitionBy("batch").orderBy("number"))).join(batches, "batch").select("number", (F.col("in_batches") + F.col("in_files")).alias("in_files"))
    in_file = held.withColumn("in_file", earlier(W.partitionBy("number").orderBy(key[1])))
    return in_file.join(of_file, "number").select(*key, first, rows, (F.col("in_files") + F.col("in_file")).alias(before))
