"""The whole clean: duplicates, outliers, gaps, dates, with lineage, audit and a report of before and after."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, fresh_path, materialize, written
from . import clean, quality


@dataclass
class Result:
    table: DataFrame
    lineage: DataFrame
    audit: DataFrame
    report: DataFrame
    decisions: list[tuple[str, int, float, str]]
    rows: dict[str, int] = field(default_factory=dict)  # of table and lineage, counted as they were written
    scratch: list[DataFrame] = field(default_factory=list)  # tables between steps

    def close(self) -> None:
        """Delete the tables between steps; table and lineage stay, audit and report can be read no more unless they were written."""
        discard(*self.scratch)
        self.scratch.clear()


def run(df: DataFrame, as_of: date, keys: list[str] = ("patient_id", "visit_date"), keep: str = "first", order_by: str = "row_id", mode: str = "sequential", folder: str | None = None) -> Result:
    """Clean a table in order: duplicates, outliers, missing cells, date flags. Table and lineage are written in the folder, or the shared one."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "clean")
    columns = quality.data_columns(df, order_by)
    # Each table is written once: what follows decides, counts and reports on it many times.
    marked = materialize(clean.mark_all_duplicates(df, list(keys), keep, order_by), "duplicates")
    kept, gone = clean.split_duplicates(marked)
    fixed, corrections = clean.fix_outliers(kept, order_by)
    fixed = materialize(fixed, "fixed")
    filled, imputed, decisions = clean.handle_missing(fixed, columns, order_by, mode)
    table, n_rows = written(clean.flag_dates(filled), f"{folder}/table")
    lineage, n_changes = written(reduce(DataFrame.unionByName, [clean.deletion_lineage(gone, order_by), corrections, imputed]), f"{folder}/lineage")
    rows = [clean.audit_row(spark, "deletion", "duplicates", F.count("*"), "duplicate_exact_matches", source=gone), clean.audit_row(spark, "correction", "outliers", F.count("*"), "outlier_biological_plausibility", source=corrections)]
    kinds = {"drop": "deletion", "median": "imputation", "flag": "flagging"}
    rows += [clean.audit_row(spark, kinds[way], f"missing:{c}", n) for c, n, _, way in decisions if way in kinds]
    rows.append(clean.audit_row(spark, "flagging", "dates", F.count_if("date_inconsistency_flag"), source=table))
    audit = reduce(DataFrame.unionByName, rows)
    report = quality.compare(quality.assess(df, as_of), quality.assess(table, as_of), len(rows), n_changes)
    return Result(table, lineage, audit, report, decisions, {"table": n_rows, "lineage": n_changes}, [marked, fixed])
