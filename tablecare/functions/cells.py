"""Cells: what is missing, what is a number, what is a date, and how a score is called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of a missing cell in a file, in lower case.
NULL_TOKENS = ("", "na", "null")
#: Text that is a number: no hex, no suffixes, no NaN or infinity.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy")
#: Least scores of the levels.
LEVELS = ((0.95, "excellent"), (0.80, "good"), (0.60, "fair"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so: for columns of our own beside a user's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def missing(df: DataFrame, column: str) -> Column:
    """Null, an empty string, or not a number."""
    c = F.col(f"`{column}`")
    if isinstance(kind(df, column), T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind(df, column), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def parse_number(c: Column) -> Column:
    """Text as a double where it reads as a number, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def number(df: DataFrame, column: str) -> Column:
    """The finite number in a cell, of a numeric or text column; else null."""
    c = F.col(f"`{column}`")
    if isinstance(kind(df, column), T.StringType):
        c = parse_number(c)
    elif is_numeric(kind(df, column)):
        c = c.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(finite(c), c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def normalize_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null tokens in text columns become null."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*NULL_TOKENS), F.col(f"`{c}`")) for c in columns})


def parse_date(c: Column) -> Column:
    """Text in one of DATE_FORMATS as a date, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def date_of(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return parse_date(c) if isinstance(kind(df, column), T.StringType) else c.cast("date")


def text(df: DataFrame, columns: list[str]) -> list[Column]:
    """Cells as text with null as empty: how cells of duplicates are compared."""
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]


def cell_hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row's cells: rows alike in them as text have the same, others hardly ever.

    Hashes are of the cells themselves, null as empty, and share no expression with their text: the optimizer would note
    every way of writing one with the other, which doubles with each column.
    """

    def cell(c: str) -> Column:
        if isinstance(kind(df, c), T.StringType):
            return F.nullif(F.col(f"`{c}`"), F.lit(""))
        return F.col(f"`{c}`") if isinstance(kind(df, c), (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else F.to_json(F.struct(F.col(f"`{c}`")))

    return [F.xxhash64(F.lit(seed), *map(cell, columns)) for seed in (1, 2)]


def maybe_repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose hashes of the given cells occur more than once: all rows with an equal one, and hardly any other.

    Only hashes are shuffled, counted before they are; rows then meet the few hashes that occur often.
    """
    one, two = free(df, "_hash1", "_hash2")
    marked = df.withColumns(dict(zip((one, two), cell_hashes(df, columns), strict=True)))
    often = marked.groupBy(one, two).agg(F.count("*").alias("n")).where("n > 1").select(one, two)
    return marked.join(often, [one, two], "left_semi").drop(one, two)


def level(score: Column) -> Column:
    chain = reduce(lambda c, x: c.when(score >= x[0], x[1]), LEVELS[1:], F.when(score >= LEVELS[0][0], LEVELS[0][1]))
    return chain.otherwise("poor")


def hash_identifier(c: Column, salt: str = "") -> Column:
    """SHA-256 of salt and value, in hex."""
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def mask(c: Column, keep: int = 4) -> Column:
    """Stars and the last characters; stars alone for short, empty or missing values."""
    c = c.cast("string")
    return F.when(c.isNull() | (F.length(c) <= keep), "********").otherwise(F.concat(F.lit("********"), F.right(c, F.lit(keep))))


def first_present(df: DataFrame, names: tuple[str, ...] | list[str], table_order: bool = False) -> str | None:
    """The first of the names that is a column; with table_order the first column that is one of the names."""
    if table_order:
        return next((c for c in df.columns if c in names), None)
    return next((n for n in names if n in df.columns), None)
