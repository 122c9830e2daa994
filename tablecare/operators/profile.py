"""Column profiles from one wide aggregate over the table, and a few passes for medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_numeric, kind, missing, number
from ..functions.stats import kurtosis, quantiles, skewness


def data_columns(df: DataFrame, ordinal: str | None = "row_id") -> list[str]:
    return [c for c in df.columns if c not in (ordinal, "_row_id")]


def with_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """n0, n1, ... each column's finite numbers, and m0, m1, ... whether a cell is missing; no column of df itself."""
    return df.select(*[number(df, c).alias(f"n{i}") for i, c in enumerate(columns)], *[missing(df, c).alias(f"m{i}") for i, c in enumerate(columns)])


def class_of(cells, numbers):
    """numeric, string, mixed or empty, from how many cells are there and how many are numbers."""
    return F.when(cells == 0, "empty").when(numbers == cells, "numeric").when(numbers == 0, "string").otherwise("mixed")


def profile(df: DataFrame, columns: list[str] | None = None, dataset_id: str = "dataset", exact: bool = True) -> DataFrame:
    """dataset_id, ordinal, column, col_type, n, missing_count, missing_rate and for numeric ones mean, median, std, min, max."""
    columns = columns or data_columns(df)
    wide = with_numbers(df, columns)
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"n{i}")
        parts += [F.count_if(F.col(f"m{i}")).alias(f"m{i}"), F.count(x).alias(f"k{i}")]
        parts += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    middle = quantiles(wide, [f"n{i}" for i in range(len(columns))], (0.5,), exact)
    one = wide.agg(*parts).withColumns({f"q{i}": F.lit(middle[f"n{i}"][1][0]).cast("double") for i in range(len(columns))})
    rows = []
    for i, c in enumerate(columns):
        col_type = class_of(F.col("n") - F.col(f"m{i}"), F.col(f"k{i}"))
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), col_type.alias("col_type"), F.col(f"m{i}").alias("missing_count"), *[F.when(col_type == "numeric", F.col(f"{k}{i}")).alias(name) for k, name in (("a", "mean"), ("q", "median"), ("s", "std"), ("l", "min"), ("h", "max"))]))
    return (
        one.select(F.lit(dataset_id).alias("dataset_id"), "n", F.explode(F.array(*rows)).alias("r"))
        .select("dataset_id", "r.ordinal", "r.column", "r.col_type", "n", "r.missing_count", F.coalesce(F.try_divide(F.col("r.missing_count"), F.col("n")), F.lit(0.0)).alias("missing_rate"), "r.mean", "r.median", "r.std", "r.min", "r.max")
    )


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, col_type, cells, numbers."""
    columns = columns or data_columns(df)
    wide = with_numbers(df, columns)
    one = wide.agg(*[x for i, c in enumerate(columns) for x in (F.count_if(~F.col(f"m{i}")).alias(f"c{i}"), F.count(f"n{i}").alias(f"k{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), class_of(F.col(f"c{i}"), F.col(f"k{i}")).alias("col_type"), F.col(f"c{i}").alias("cells"), F.col(f"k{i}").alias("numbers")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns of which every cell that is there is a number. Numeric types need no pass; text columns take one."""
    columns = columns or data_columns(df)
    text = [c for c in columns if not is_numeric(kind(df, c)) and kind(df, c).simpleString() == "string"]
    found = {r.column for r in column_types(df, text).collect() if r.col_type == "numeric"} if text else set()
    return [c for c in columns if is_numeric(kind(df, c)) or c in found]


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, tuple[int, float | None, float | None]]:
    """How many numbers each column has, and their quartiles: few numbers, at the driver."""
    found = quantiles(with_numbers(df, columns), [f"n{i}" for i in range(len(columns))], (0.25, 0.75), exact)
    return {c: (found[f"n{i}"][0], *found[f"n{i}"][1]) for i, c in enumerate(columns)}


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, median, std, skewness, excess_kurtosis, near_normal of columns with four values or more."""
    wide = with_numbers(df, columns)
    parts = []
    for i in range(len(columns)):
        x = F.col(f"n{i}")
        parts += [F.count(x).alias(f"k{i}"), F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}"), skewness(x).alias(f"w{i}"), kurtosis(x).alias(f"u{i}")]
    middle = quantiles(wide, [f"n{i}" for i in range(len(columns))], (0.5,))
    one = wide.agg(*parts).withColumns({f"q{i}": F.lit(middle[f"n{i}"][1][0]).cast("double") for i in range(len(columns))})
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(name) for k, name in (("k", "n"), ("a", "mean"), ("q", "median"), ("s", "std"), ("w", "skewness"), ("u", "excess_kurtosis"))]) for i, c in enumerate(columns)]
    near = (F.abs("skewness") < 2) & (F.abs(F.col("excess_kurtosis") - 3) < 7)
    return one.select(F.inline(F.array(*rows))).where("n >= 4").withColumn("near_normal", near)
