"""Lineage as a patch: a cleaned table taken back to its source, or a source brought forward again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import free

#: The order in which a clean changes a cell.
STEPS = ("correction", "imputation", "deletion")


def _patch(lineage: DataFrame, backward: bool) -> DataFrame:
    """number, cells (field to value: the first one that a cell had, or the last), deleted. One row for each row changed.

    A row has an entry for each of its columns and steps at most, so what is gathered for it is bounded.
    """
    step = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("operation"))
    entry = F.struct("field", step.alias("step"), F.col("original_value" if backward else "new_value").alias("value"))
    rows = lineage.groupBy(F.col("row_id").alias("number")).agg(F.collect_list(entry).alias("entries"), F.bool_or(F.col("operation") == "deletion").alias("deleted"))
    return rows.select("number", "deleted", F.sort_array("entries", asc=backward).alias("entries"))


def _value(field: str, kind: T.DataType) -> tuple[Column, Column]:
    """(whether a patch has a value of a column, the value)."""
    own = F.get(F.filter("entries", lambda e: e["field"] == field), F.lit(0))
    return own.isNotNull(), own["value"].try_cast(kind)


def restore(cleaned: DataFrame, lineage: DataFrame, columns: list[str] | None = None, order_by: str = "row_id") -> DataFrame:
    """The table as it was before a clean: changed cells have their first value, deleted rows are back, in the given columns.

    columns are the source's (default: all of cleaned but flags). lineage has record_id, row_id, field, original_value,
    new_value and operation, as a clean writes it; values are text in the form that a cast gives, and come back in the
    types of cleaned. A table without lineage is itself. Rows are told apart by order_by.
    """
    columns = [c for c in cleaned.columns if c != order_by and not c.endswith("_flag")] if columns is None else columns
    number, there = free(cleaned, "_number", "_there")
    entries, deleted = "entries", "deleted"
    now = cleaned.select(F.col(order_by).alias(number), F.lit(True).alias(there), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("now"))
    both = now.join(_patch(lineage, True).withColumnRenamed("number", "patched"), F.col(number) == F.col("patched"), "full")
    cells = []
    for i, c in enumerate(columns):
        has, value = _value(c, cleaned.schema[c].dataType)
        cells.append(F.when(has, value).otherwise(F.col(f"now.c{i}")).alias(c))
    return both.where(F.col(there) | F.col(deleted)).select(F.coalesce(number, "patched").cast(cleaned.schema[order_by].dataType).alias(order_by), *cells)


def replay(source: DataFrame, lineage: DataFrame, columns: list[str] | None = None, order_by: str = "row_id") -> DataFrame:
    """The source with a clean's changes made again: rows deleted, cells with their last value."""
    columns = [c for c in source.columns if c != order_by] if columns is None else columns
    patch = _patch(lineage, False).withColumnRenamed("number", "patched")
    named = source.select(F.col(order_by).alias("number"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("now"))
    both = named.join(patch, F.col("number") == F.col("patched"), "left").where(~F.coalesce("deleted", F.lit(False)))
    cells = []
    for i, c in enumerate(columns):
        has, value = _value(c, source.schema[c].dataType)
        cells.append(F.when(has, value).otherwise(F.col(f"now.c{i}")).alias(c))
    return both.select(F.col("number").alias(order_by), *cells)
