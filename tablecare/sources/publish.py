"""A clean published as one act: all files of a run, then a manifest that names them, written last.

Readers go by manifests, so a run that dies midway shows nothing, and one that is published shows all of its files at
once. The manifest has the rows of each file, counted while they were written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.storage import file_system, get, names, put, written
from ..operators import pipeline


@dataclass
class Run:
    """A published run: what its manifest says, and its tables by name (table, lineage, audit, report)."""

    manifest: dict
    tables: dict[str, DataFrame]


def clean(df: DataFrame, path: str, run: str, as_of: date, source: str = "dataset", user: str = "tablecare", **options) -> Run:
    """Clean a table and publish the run under its name; a name is published once. options are those of pipeline.run()."""
    spark = df.sparkSession
    if run in published(spark, path):
        raise ValueError(f"run {run} is published")
    folder = f"{path}/runs/{run}"
    fs, place = file_system(spark, folder)
    fs.delete(place, True)  # what an attempt that failed has left
    done = pipeline.run(df, as_of, folder=folder, **options)
    files = {"table": (done.table, done.rows["table"]), "lineage": (done.lineage, done.rows["lineage"])}
    files |= {name: written(getattr(done, name), f"{folder}/{name}") for name in ("audit", "report")}
    report = files["report"][0].first().asDict()
    manifest = {
        "run": run, "source": source, "user": user, "as_of": as_of.isoformat(), "report": report, "operation_count": files["audit"][1],
        "decisions": [{"column": c, "missing_count": n, "missing_rate": rate, "strategy": way} for c, n, rate, way in done.decisions],
        "files": {name: {"path": f"runs/{run}/{name}", "rows": n, "schema": t.schema.jsonValue()} for name, (t, n) in files.items()},
    }
    put(spark, f"{path}/manifests/{run}.json", json.dumps(manifest))
    done.close()
    return read(spark, path, run)


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that are published, in alphabetical order."""
    return sorted(n.removesuffix(".json") for n in names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith("."))


def read(spark: SparkSession, path: str, run: str | None = None) -> Run:
    """A published run (default: the last by name) with its tables, in the types that they were written in."""
    known = published(spark, path)
    if not known or (run is not None and run not in known):
        raise ValueError(f"run {run or ''} is not published")
    manifest = json.loads(get(spark, f"{path}/manifests/{run or known[-1]}.json"))
    tables = {name: spark.read.schema(T.StructType.fromJson(f["schema"])).parquet(f"{path}/{f['path']}") for name, f in manifest["files"].items()}
    return Run(manifest, tables)


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete the files of runs that were never published; returns their names. Not while a run is under way."""
    known = set(published(spark, path))
    left = [n for n in names(spark, f"{path}/runs") if n not in known]
    for run in left:
        fs, place = file_system(spark, f"{path}/runs/{run}")
        fs.delete(place, True)
    return left
