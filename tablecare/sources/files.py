"""Delimited files in, cleaned tables and reports out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import normalize_nulls
from ..functions.storage import names, put
from .ordering import number_rows

ROW_ID = "_row_id"
#: Folder of an export with the counts of its appends; readers of data skip it.
COUNTS = "_counts"
#: Separators by file ending.
ENDINGS = {".csv": ",", ".txt": ",", ".tsv": "\t"}


def read_table(spark: SparkSession, paths: str | list[str], separator: str | None = None, multi_line: bool = False, row_id: bool = True) -> DataFrame:
    """Delimited files (all paths) with a header, every cell text, null tokens null; JSON and parquet by their ending.

    Short rows are padded with missing cells, long ones cut, blank lines skipped. `_row_id` counts the rows from 0, in the
    order of the paths, of the names of files in a folder, and of each file; for it the files are read once to be counted.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("a dataset needs at least one path")
    ending = "." + paths[0].rstrip("/").rpartition(".")[2].lower()
    if ending == ".json":
        df = spark.read.json(paths)
    elif ending == ".parquet":
        df = spark.read.parquet(*paths)
    elif separator or ending in ENDINGS:
        df = spark.read.csv(paths, header=True, sep=separator or ENDINGS[ending], quote='"', escape='"', inferSchema=False, mode="PERMISSIVE", multiLine=multi_line)
    else:
        raise ValueError(f"no reader for {ending}")
    text = ending not in (".json", ".parquet")
    df = number_rows(df, paths, ROW_ID, "parquet" if ending == ".parquet" else "text") if row_id else df
    return normalize_nulls(df) if text else df


def preview(df: DataFrame, rows: int = 5, order_by: str = ROW_ID) -> DataFrame:
    """The first rows, cells trimmed as text."""
    return df.orderBy(order_by).limit(rows).select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def head(df: DataFrame, rows: int = 5, order_by: str = ROW_ID) -> DataFrame:
    return df.orderBy(order_by).limit(rows)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed; null as an empty cell."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_metadata(spark: SparkSession, path: str, source: str, output: str, user: str, report: DataFrame, operations: int) -> None:
    """One JSON row beside a cleaned table: where it came from, who cleaned it, its report and how many operations."""
    row = report.select(F.to_json(F.struct("*")).alias("quality_report")).withColumns({"source": F.lit(source), "output": F.lit(output), "user": F.lit(user), "operation_count": F.lit(operations)})
    row.write.mode("overwrite").json(path)


def export(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None) -> int:
    """Append an audit or lineage table and return how many rows the export now has.

    Rows are counted as they are written, and every append leaves an empty file with its count in its name beside the
    data, so that no export is read again.
    """
    spark, seen = df.sparkSession, Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    getattr(writer, kind)(path)
    put(spark, f"{path}/{COUNTS}/{uuid.uuid4().hex}-{seen.get['n']}", "")
    return sum(int(n.rpartition("-")[2]) for n in names(spark, f"{path}/{COUNTS}") if not n.startswith("."))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def dataset(dataset_id: str, dataset_type: str, raw_paths: list[str], **more: str) -> dict:
    """A descriptor of one dataset; `ehr` is another name of `clinical_trial`."""
    kind = {"ehr": "clinical_trial"}.get(dataset_type, dataset_type)
    if kind != "clinical_trial" or not raw_paths:
        raise ValueError("a clinical dataset with at least one path is wanted")
    return {"dataset_id": dataset_id, "dataset_type": kind, "raw_paths": list(raw_paths), **more}
