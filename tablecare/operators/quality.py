"""Quality dimensions of a table: completeness, validity, consistency, uniqueness, timeliness, and the report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.cells import date_of, level, maybe_repeated, missing, number, text
from .profile import data_columns, numeric_columns, quartiles


def _score(errors: Column, base: Column) -> Column:
    """One less the share of errors, not below zero; 1 where there is nothing to err."""
    return F.when(base > 0, F.greatest(F.lit(0.0), 1 - errors / base)).otherwise(1.0)


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_rows, n_columns, missing_cells, score, level; an empty table scores 0."""
    columns = columns or data_columns(df)
    one = df.agg(F.count("*").alias("n_rows"), _total([F.count_if(missing(df, c)) for c in columns]).alias("missing_cells")).withColumn("n_columns", F.lit(len(columns)))
    score = F.when(F.col("n_rows") * len(columns) > 0, F.greatest(F.lit(0.0), 1 - F.col("missing_cells") / (F.col("n_rows") * len(columns)))).otherwise(0.0)
    return one.withColumn("score", score).withColumn("level", level(F.col("score")))


def completeness_findings(profile: DataFrame) -> DataFrame:
    """column, missing_rate, finding of columns with more missing cells than are noted."""
    return profile.select("column", "missing_rate", F.when(F.col("missing_rate") > R.MISSING_SEVERE, "severe").when(F.col("missing_rate") > R.MISSING_NOTED, "noted").alias("finding")).where("finding IS NOT NULL")


def range_violations(df: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """column, low, high, violations for each given range of a column that is there."""
    bounds = [b for b in bounds if b[0] in df.columns]
    one = df.agg(*[F.count_if(~number(df, c).between(low, high)).alias(f"v{i}") for i, (c, low, high) in enumerate(bounds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.col(f"v{i}").alias("violations")) for i, (c, low, high) in enumerate(bounds)])))


def negatives(df: DataFrame, columns: tuple[str, ...] = R.NEGATIVE_CHECKED) -> DataFrame:
    """column, negatives of columns that can't be below zero."""
    found = [c for c in columns if c in df.columns]
    one = df.agg(*[F.count_if(number(df, c) < 0).alias(f"v{i}") for i, c in enumerate(found)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("negatives")) for i, c in enumerate(found)])))


def fences(df: DataFrame, columns: list[str], width: float = R.FENCE, exact: bool = True) -> dict[str, tuple[int, float | None, float | None]]:
    """How many numbers each column has, and its quartiles less and plus `width` interquartile ranges."""
    out = {}
    for c, (n, q1, q3) in quartiles(df, columns, exact).items():
        out[c] = (n, q1 - (q3 - q1) * width, q3 + (q3 - q1) * width) if n else (0, None, None)
    return out


def _beyond(df: DataFrame, limits: dict[str, tuple[int, float | None, float | None]]) -> dict[str, Column]:
    """For each column with enough values, how many lie outside its fences."""
    return {c: F.count_if((number(df, c) < low) | (number(df, c) > high)) for c, (n, low, high) in limits.items() if n >= R.FENCE_VALUES}


def extremes(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, low, high, extremes: values outside the fences, of columns with enough values."""
    limits = fences(df, columns, exact=exact)
    out = _beyond(df, limits)
    if not out:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, extremes long")
    one = df.agg(*[x.alias(f"e{i}") for i, x in enumerate(out.values())])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(limits[c][1]).alias("low"), F.lit(limits[c][2]).alias("high"), F.col(f"e{i}").alias("extremes")) for i, c in enumerate(out)]
    return one.select(F.inline(F.array(*rows)))


def _invalid(df: DataFrame, numeric: list[str], bounds: list[tuple[str, float, float]]) -> Column:
    return _total([F.count_if(~number(df, c).between(low, high)) for c, low, high in bounds if c in numeric] + [F.count_if(number(df, c) < 0) for c in R.NEGATIVE_CHECKED if c in numeric])


def validity(df: DataFrame, columns: list[str] | None = None, bounds: list[tuple[str, float, float]] = (), exact: bool = True) -> DataFrame:
    """n_rows, n_numeric, invalid, outliers, score, level."""
    numeric = numeric_columns(df, columns or data_columns(df))
    out = _beyond(df, fences(df, numeric, exact=exact))
    one = df.agg(F.count("*").alias("n_rows"), _invalid(df, numeric, bounds).alias("invalid"), _total(list(out.values())).alias("outliers")).withColumn("n_numeric", F.lit(len(numeric)))
    return one.withColumn("score", _score(F.col("invalid") + F.col("outliers"), F.col("n_rows") * max(1, len(numeric)))).withColumn("level", level(F.col("score")))


def bmi_errors(df: DataFrame) -> Column:
    """Rows whose body mass index is not that of weight and height (over 3: centimetres)."""
    if not {"bmi", "weight", "height"} <= set(df.columns):
        return F.lit(0).cast("long")
    h = number(df, "height")
    metres = F.when(h > 3, h / 100).otherwise(h)
    return F.count_if((h > 0) & (F.abs(number(df, "weight") / F.pow(metres, 2) - number(df, "bmi")) > R.BMI_TOLERANCE))


def order_errors(df: DataFrame) -> list[tuple[str, str, Column]]:
    """(earlier, later, rows in the wrong order) of date columns that are there."""
    return [(a, b, F.count_if(date_of(df, b) < date_of(df, a))) for a, b in R.DATE_PAIRS if a in df.columns and b in df.columns]


def age_errors(df: DataFrame, as_of: date) -> Column:
    if not {"age", "birth_date"} <= set(df.columns):
        return F.lit(0).cast("long")
    years = F.datediff(F.lit(as_of), date_of(df, "birth_date")) / R.DAYS_A_YEAR
    return F.count_if(F.abs(years - number(df, "age")) > R.AGE_TOLERANCE)


def _inconsistent(df: DataFrame, as_of: date) -> dict[str, Column]:
    return {"bmi_errors": bmi_errors(df), "date_errors": _total([c for *_, c in order_errors(df)]), "age_errors": age_errors(df, as_of)}


def _future(df: DataFrame, dates: list[str], as_of: date) -> Column:
    return _total([F.count_if(date_of(df, c) > F.lit(as_of)) for c in dates])


def consistency(df: DataFrame, as_of: date) -> DataFrame:
    """n_rows, bmi_errors, date_errors, age_errors, score, level."""
    one = df.agg(F.count("*").alias("n_rows"), *[c.alias(name) for name, c in _inconsistent(df, as_of).items()])
    return one.withColumn("score", _score(F.col("bmi_errors") + F.col("date_errors") + F.col("age_errors"), F.col("n_rows"))).withColumn("level", level(F.col("score")))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, duplicates: rows beyond the first of each combination of cells, null and empty alike.

    Rows whose hashes occur once are no duplicates; the others are compared by their cells.
    """
    names = [f"k{i}" for i in range(len(columns))]
    some = maybe_repeated(df, columns).select(*[c.alias(n) for c, n in zip(text(df, columns), names, strict=True)])
    twice = some.groupBy(*names).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return df.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(twice))  # one row each


def uniqueness(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """n_rows, exact_duplicates, composite_duplicates (of two keys or more), score, level."""
    keys = [k for k in keys if k in df.columns]
    one = duplicates(df, columns or data_columns(df)).withColumnRenamed("duplicates", "exact_duplicates")
    composite = duplicates(df, keys).select(F.col("duplicates").alias("composite_duplicates")) if len(keys) > 1 else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("composite_duplicates"))
    both = one.crossJoin(F.broadcast(composite))  # one row each
    return both.withColumn("score", _score(F.col("exact_duplicates") + F.col("composite_duplicates"), F.col("n_rows"))).withColumn("level", level(F.col("score")))


def timeliness(df: DataFrame, dates: list[str], as_of: date) -> DataFrame:
    """n_rows, future_dates, score, level."""
    one = df.agg(F.count("*").alias("n_rows"), _future(df, dates, as_of).alias("future_dates"))
    return one.withColumn("score", _score(F.col("future_dates"), F.col("n_rows"))).withColumn("level", level(F.col("score")))


def date_ages(df: DataFrame, dates: list[str], as_of: date) -> DataFrame:
    """column, future, mean_age_days, stale."""
    parts = []
    for i, c in enumerate(dates):
        d = date_of(df, c)
        parts += [F.count_if(d > F.lit(as_of)).alias(f"f{i}"), F.round(F.avg(F.when(d <= F.lit(as_of), F.datediff(F.lit(as_of), d)))).cast("long").alias(f"a{i}")]
    one = df.agg(*parts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("future"), F.col(f"a{i}").alias("mean_age_days")) for i, c in enumerate(dates)]))).withColumn("stale", F.coalesce(F.col("mean_age_days") > R.STALE_DAYS, F.lit(False)))


def known_keys(df: DataFrame) -> list[str]:
    return [c for c in ("patient_id",) if c in df.columns]


def known_dates(df: DataFrame) -> list[str]:
    return [c for c in R.DATE_NAMES if c in df.columns]


def discover(df: DataFrame) -> DataFrame:
    """column, role (key or date), n, missing_count, different: the default keys and dates of a table, from its cells."""
    roles = {c: "key" for c in known_keys(df)} | {c: "date" for c in known_dates(df)}
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.when(~missing(df, c), F.col(c).cast("string")).alias("value")) for c, r in roles.items()]))
    values = df.select(cells).groupBy("column", "role", "value").agg(F.count("*").alias("k"))
    return values.groupBy("column", "role").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("missing_count"), F.count("value").alias("different"))


WEIGHTS = {"completeness": 0.3, "validity": 0.3, "consistency": 0.2, "uniqueness": 0.2}
WEIGHTS_WITH_DATES = {"completeness": 0.25, "validity": 0.25, "consistency": 0.2, "uniqueness": 0.2, "timeliness": 0.1}


def assess(df: DataFrame, as_of: date, name: str = "dataset", keys: list[str] | None = None, dates: list[str] | None = None, bounds: list[tuple[str, float, float]] = (), columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row: dataset_name, n_rows, n_columns, a score for each dimension, overall score and level."""
    columns = columns or data_columns(df)
    keys = known_keys(df) if keys is None else keys
    dates = known_dates(df) if dates is None else dates
    numeric = numeric_columns(df, columns)
    out = _beyond(df, fences(df, numeric, exact=exact))
    # One pass for all that is counted row by row; distinct rows and keys take an aggregate each.
    one = df.agg(
        F.count("*").alias("n_rows"), _total([F.count_if(missing(df, c)) for c in columns]).alias("missing"), (_invalid(df, numeric, bounds) + _total(list(out.values()))).alias("wrong"),
        _total(list(_inconsistent(df, as_of).values())).alias("inconsistent"), _future(df, dates, as_of).alias("future"),
    )
    one = one.crossJoin(F.broadcast(uniqueness(df, columns, keys).select(F.col("score").alias("uniqueness"))))  # one row each
    cells = F.col("n_rows") * len(columns)
    scores = {
        "completeness": F.when(cells > 0, F.greatest(F.lit(0.0), 1 - F.col("missing") / cells)).otherwise(0.0), "validity": _score(F.col("wrong"), F.col("n_rows") * max(1, len(numeric))),
        "consistency": _score(F.col("inconsistent"), F.col("n_rows")), "uniqueness": F.col("uniqueness"), **({"timeliness": _score(F.col("future"), F.col("n_rows"))} if dates else {}),
    }
    report = one.select(F.lit(name).alias("dataset_name"), "n_rows", F.lit(len(columns)).alias("n_columns"), *[c.alias(d) for d, c in scores.items()])
    weights = WEIGHTS_WITH_DATES if dates else WEIGHTS
    overall = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _total([F.col(d) * w for d, w in weights.items()])))
    return report.withColumn("overall", overall).withColumn("level", level(F.col("overall")))


def dimension_rows(report: DataFrame) -> DataFrame:
    """dimension, score, level of every dimension in a report."""
    names = [d for d in WEIGHTS_WITH_DATES if d in report.columns]
    return report.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in names]))).withColumn("level", level(F.col("score")))


def compare(before: DataFrame, after: DataFrame, operations: int | Column = 0, changes: int | Column = 0) -> DataFrame:
    """One row: scores and levels before and after, improvement, rows in, out and removed, operations, changed cells."""
    b = before.select(F.col("n_rows").alias("rows_in"), F.col("overall").alias("score_before"), F.col("level").alias("level_before"))
    a = after.select(F.col("n_rows").alias("rows_out"), F.col("overall").alias("score_after"), F.col("level").alias("level_after"))
    gain = F.col("score_after") - F.col("score_before")
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    both = b.crossJoin(F.broadcast(a))  # one row each
    return both.withColumns({"improvement": gain, "improvement_percent": F.coalesce(F.try_divide(gain * 100, F.col("score_before")), F.lit(0.0)), "rows_removed": F.col("rows_in") - F.col("rows_out"), "operation_count": wrap(operations), "lineage_count": wrap(changes)})
