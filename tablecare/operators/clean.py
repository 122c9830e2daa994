"""Cleaning: duplicates, outliers, gaps, dates and transformations. Functions return new tables; lineage is beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.cells import date_of, first_present, free, maybe_repeated, missing, number, parse_date, text
from ..functions.stats import quantiles
from ..functions.storage import materialize
from .gaps import Gaps, held
from .profile import data_columns, numeric_columns
from .quality import fences

LINEAGE = "record_id string, row_id long, field string, original_value string, new_value string, operation string, evidence_id string"


def duplicate_rows(df: DataFrame, columns: list[str], keep: str = "first", order_by: str = "row_id") -> DataFrame:
    """Row numbers of the rows that go: all of each combination of cells (as text, null as empty) but the first, last or most complete.

    Rows that may have an equal are found by hashes of their cells; these alone are grouped by the cells themselves, with
    partial results, so that a combination that many rows share never meets in one task. order_by tells rows apart: it
    must be unique, and a null in a row with an equal is an error.
    """
    some, number_ = maybe_repeated(df, columns), F.col(order_by).alias("number")
    gaps = sum([missing(df, c).cast("int") for c in data_columns(df, order_by)], F.lit(0)) if keep == "complete" else F.lit(0)
    keys = [f"k{i}" for i in range(len(columns))]
    keyed = some.select(number_, gaps.alias("gaps"), *[c.alias(k) for c, k in zip(text(df, columns), keys, strict=True)])
    best = {"first": F.min("number"), "last": F.max("number"), "complete": F.min(F.struct("gaps", "number"))["number"]}[keep]
    error = F.raise_error(f"a row without a {order_by} has an equal: rows must be numbered").cast(df.schema[order_by].dataType)
    stay = keyed.groupBy(*keys).agg(F.when((F.count("*") > 1) & (F.count("number") < F.count("*")), error).otherwise(best).alias("number"))
    return some.select(number_).join(stay.select("number"), "number", "left_anti").distinct()


def _with(df: DataFrame, gone: DataFrame, order_by: str, name: str) -> DataFrame:
    """df with what gone (number, what) says of its rows as a last column."""
    number_, = free(df, "_number")
    gone = gone.select(F.col("number").alias(number_), F.col("what").alias(name))
    return df.join(gone, F.col(order_by) == F.col(number_), "left").drop(number_)


def mark_duplicates(df: DataFrame, columns: list[str], keep: str = "first", order_by: str = "row_id") -> DataFrame:
    """df with a last column `_place` (more underscores if it has one): 1 for the row of each combination of cells that stays, else 2."""
    place, = free(df, "_place")
    marked = _with(df, duplicate_rows(df, columns, keep, order_by).withColumn("what", F.lit(2)), order_by, place)
    return marked.withColumn(place, F.coalesce(place, F.lit(1)))


def mark_all_duplicates(df: DataFrame, keys: list[str] = ("patient_id", "visit_date"), keep: str = "first", order_by: str = "row_id") -> DataFrame:
    """df with a last column `_operation` (more underscores if it has one): exact_duplicate for rows alike in all cells but for the one that stays, then composite_duplicate for rows of those left alike in the keys, else null.

    Cells are compared as text with null as empty. The numbers of rows alike in all cells are written, so that the second
    search does not begin with the first.
    """
    columns = data_columns(df, order_by)
    keys = [k for k in keys if k in columns]
    exact = duplicate_rows(df, columns, keep, order_by)
    gone = exact.withColumn("what", F.lit("exact_duplicate"))
    if keys:
        exact = materialize(exact, "duplicates")
        left = _with(df, exact.withColumn("what", F.lit(True)), order_by, free(df, "_gone")[0])
        left = left.where(F.col(left.columns[-1]).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
        gone = exact.withColumn("what", F.lit("exact_duplicate")).union(duplicate_rows(left, keys, keep, order_by).withColumn("what", F.lit("composite_duplicate")))
    return _with(df, gone, order_by, free(df, "_operation")[0])


def split_duplicates(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows deleted with their last column, what they are)."""
    operation = marked.columns[-1]
    return marked.where(F.col(operation).isNull()).drop(operation), marked.where(F.col(operation).isNotNull())


def drop_duplicates(df: DataFrame, keys: list[str] = ("patient_id", "visit_date"), keep: str = "first", order_by: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows deleted): first rows alike in all cells, then of those left rows alike in the keys."""
    return split_duplicates(mark_all_duplicates(df, keys, keep, order_by))


def flag_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `duplicate_flag` for every row of a combination that occurs more than once.

    Rows meet a table with one row for each repeated combination; a combination that many rows share is a skewed side of
    that join, which adaptive execution splits.
    """
    names = free(df, *[f"_k{i}" for i in range(len(keys))], "_n", *[f"_r{i}" for i in range(len(keys))])
    own, n, other = names[: len(keys)], names[len(keys)], names[len(keys) + 1 :]
    keyed = df.withColumns(dict(zip(own, text(df, keys), strict=True)))
    often = keyed.groupBy(*own).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(*[F.col(a).alias(b) for a, b in zip(own, other, strict=True)])
    on = [F.col(a) == F.col(b) for a, b in zip(own, other, strict=True)]
    return keyed.join(often, on, "left").withColumn("duplicate_flag", F.col(other[0]).isNotNull()).drop(*own, *other)


def drop_duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose combination occurs once."""
    return flag_duplicates(df, keys).where("NOT duplicate_flag").drop("duplicate_flag")


def record_id(df: DataFrame, order_by: str = "row_id") -> Column:
    """The patient, or the row where there is none."""
    row = F.concat(F.lit("row_"), F.col(order_by).cast("string"))
    return F.coalesce(F.nullif(F.col("patient_id").cast("string"), F.lit("")), row) if "patient_id" in df.columns else row


def deletion_lineage(gone: DataFrame, order_by: str = "row_id", evidence: str = "duplicate_exact_matches") -> DataFrame:
    """A row for each cell of each deleted row; duplicates by their keys alone have a rule of their own.

    gone is split_duplicates()'s second table, whose last column says what its rows are, or any other table.
    """
    operation = gone.columns[-1] if gone.columns[-1].startswith("_") and gone.columns[-1].lstrip("_") == "operation" else None
    columns = [c for c in data_columns(gone, order_by) if c != operation]
    evidence_id = F.when(F.col(operation) == "composite_duplicate", "duplicate_partial_matches").otherwise(evidence) if operation else F.lit(evidence)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("original_value")) for c in columns]))
    return gone.select(record_id(gone, order_by).alias("record_id"), F.col(order_by).alias("row_id"), evidence_id.alias("evidence_id"), cells).select("record_id", "row_id", "field", "original_value", F.lit(None).cast("string").alias("new_value"), F.lit("deletion").alias("operation"), "evidence_id")


def impossible_limits(df: DataFrame) -> dict[str, tuple[float, float]]:
    return {c: (low, high) for names, low, high in R.IMPOSSIBLE for c in df.columns if c in names}


def fix_outliers(df: DataFrame, order_by: str = "row_id", width: float = R.FENCE, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table, lineage): impossible values of known columns become null; other numbers are capped at fences.

    Fences need four values and quartiles that differ; they are few numbers read to the driver once.
    """
    columns = data_columns(df, order_by)
    numeric = numeric_columns(df, columns)
    limits = {c: b for c, b in impossible_limits(df).items() if c in numeric}
    others = [c for c in numeric if c not in limits]
    caps = {c: (low, high) for c, (n, low, high) in fences(df, others, width, exact).items() if n >= R.FENCE_VALUES and low != high}
    return _corrected(df, {c: ("nullify", *b) for c, b in limits.items()} | {c: ("cap", *b) for c, b in caps.items()}, order_by)


def treat_outliers(df: DataFrame, choices: dict[str, tuple[str, float, float]], order_by: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(table, lineage) by given bounds: column to (nullify, cap, keep or flag, low, high)."""
    flags = {f"{c}_outlier_flag": F.coalesce(~number(df, c).between(low, high), F.lit(False)) for c, (way, low, high) in choices.items() if way == "flag"}
    fixed, lineage = _corrected(df, {c: x for c, x in choices.items() if x[0] in ("nullify", "cap")}, order_by)
    return fixed.withColumns(flags) if flags else fixed, lineage


def _corrected(df: DataFrame, choices: dict[str, tuple[str, float, float]], order_by: str) -> tuple[DataFrame, DataFrame]:
    new, changes = {}, []
    for c, (way, low, high) in choices.items():
        x = number(df, c)
        value = F.when(x < low, low).when(x > high, high).otherwise(x) if way == "cap" else F.when(x.between(low, high), x)
        new[c] = F.when(x.isNull(), F.col(f"`{c}`").cast("double")).otherwise(value).cast(df.schema[c].dataType)
        rule = "outlier_iqr_method" if way == "cap" else "outlier_biological_plausibility"
        changes.append(F.when((x < low) | (x > high), F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("original_value"), new[c].cast("string").alias("new_value"), F.lit("correction").alias("operation"), F.lit(rule).alias("evidence_id"))))
    if not new:
        return df, df.sparkSession.createDataFrame([], LINEAGE)
    # Only rows that change are unfolded.
    changed = df.select(record_id(df, order_by).alias("record_id"), F.col(order_by).alias("row_id"), F.filter(F.array(*changes), lambda x: x.isNotNull()).alias("changes")).where("size(changes) > 0")
    return df.withColumns(new), changed.select("record_id", "row_id", F.inline("changes"))


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Numbers beyond the given quantiles take their values."""
    limits = _quantiles(df, columns, low, high)
    return df.withColumns({c: F.when(number(df, c).isNotNull(), F.greatest(F.lit(limits[c][0]), F.least(F.lit(limits[c][1]), number(df, c)))) for c in columns if limits[c][0] is not None})


def _quantiles(df: DataFrame, columns: list[str], low: float, high: float) -> dict[str, tuple[float, float]]:
    wide = df.select(*[number(df, c).alias(f"_n{i}") for i, c in enumerate(columns)])
    found = quantiles(wide, [f"_n{i}" for i in range(len(columns))], (low, high))
    return {c: tuple(found[f"_n{i}"][1]) for i, c in enumerate(columns)}


def drop_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows without a number out of bounds; missing cells stay."""
    keep = F.lit(True)
    for c, (low, high) in bounds.items():
        keep = keep & F.coalesce(number(df, c).between(low, high), F.lit(True))
    return df.where(keep)


def _strategy(found: Gaps, column: str, auto: bool) -> str:
    """drop, median, flag or no_action for a column of the table that found is of."""
    gone = found.missing[column]
    if not gone:
        return "no_action"
    rate, fill = gone / found.rows, "median" if column in found.numbers else "flag"
    if not auto:
        return fill
    if rate < R.DROP_BELOW and found.random(column):
        return "drop"
    return fill if rate < R.MEDIAN_BELOW else "flag"


def missing_decisions(df: DataFrame, columns: list[str], auto: bool = True, numbers: list[str] | None = None) -> DataFrame:
    """column, missing_count, missing_rate, mcar, strategy (drop, median, flag or no_action) for the table as it is."""
    found = held(df, columns, numeric_columns(df, columns) if numbers is None else numbers)
    rows = [(c, found.missing[c], found.missing[c] / found.rows if found.rows else 0.0, found.random(c), _strategy(found, c, auto)) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, missing_count long, missing_rate double, mcar boolean, strategy string")


def impute(df: DataFrame, column: str, value, order_by: str = "row_id", evidence: str = "missing_median_imputation_robust") -> tuple[DataFrame, DataFrame]:
    """(table, lineage): missing cells take a value."""
    gap = missing(df, column)
    lineage = df.where(gap).select(record_id(df, order_by).alias("record_id"), F.col(order_by).alias("row_id"), F.lit(column).alias("field"), F.lit(None).cast("string").alias("original_value"), F.lit(value).cast(df.schema[column].dataType).cast("string").alias("new_value"), F.lit("imputation").alias("operation"), F.lit(evidence).alias("evidence_id"))
    return df.withColumn(column, F.when(gap, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(f"`{column}`"))), lineage


def center(df: DataFrame, column: str, way: str = "median"):
    """The median, mean or most frequent value (the smallest of equals) of a column."""
    if way == "mode":
        rows = df.where(~missing(df, column)).groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).collect()
        return rows[0].v if rows else None
    wide = df.select(number(df, column).alias("_n0"))
    return wide.agg(F.avg("_n0")).first()[0] if way == "mean" else quantiles(wide, ["_n0"], (0.5,))["_n0"][1][0]


def flag_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_missing_flag", missing(df, column))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(~missing(df, column))


def decide_missing(df: DataFrame, columns: list[str], numbers: list[str], mode: str = "sequential", auto: bool = True) -> list[tuple[str, int, float, str, float | None]]:
    """(column, missing cells, their share, strategy, value to fill in) of every column with gaps, in order.

    Each column is decided on the table as it is after the columns before it (sequential) or at first (snapshot); medians
    are those of the table as it then is. Filling changes what is known by formula, so the table is read again only after
    rows are dropped: a few passes, and as many again for each column that drops rows.
    """
    first = held(df, columns, numbers)
    left, found, out = [c for c in columns if first.missing[c]], first, []
    chosen = {c: _strategy(first, c, auto) for c in left}
    while left:
        middle, dropped = None, None
        while left and not dropped:
            c = left[0]
            way = chosen[c] if mode == "snapshot" and found.missing[c] else _strategy(found, c, auto)
            if way == "median" and middle is None:  # of all columns that may need it before rows are dropped again
                fill = [f for f in left if f in numbers]
                wide = df.select(*[number(df, f).alias(f"n{i}") for i, f in enumerate(fill)])
                medians = quantiles(wide, [f"n{i}" for i in range(len(fill))], (0.5,))
                middle = {f: medians[f"n{i}"][1][0] for i, f in enumerate(fill)}
            out.append((c, found.missing[c], found.missing[c] / found.rows if found.rows else 0.0, way, middle[c] if way == "median" else None))
            if way == "median":
                found.fill(c, middle[c])
            dropped = c if way == "drop" else None
            left.pop(0)
        if dropped and left:
            df = drop_missing(df, dropped)
            found = held(df, columns, numbers, found.unfilled)
            for c, *_, value in out:
                found.fill(c, value)
    return out


def handle_missing(df: DataFrame, columns: list[str] | None = None, order_by: str = "row_id", mode: str = "sequential", auto: bool = True) -> tuple[DataFrame, DataFrame, list[tuple[str, int, float, str]]]:
    """(table, lineage, decisions): every column with gaps, in table order, by the share of gaps and their randomness.

    sequential: each column sees what was dropped and filled before it. snapshot: all are decided on the table as it was,
    so decisions can differ. Table and lineage are one projection of df each, whatever the number of columns. Lineage has
    the cells of dropped rows, as they then were, and of filled ones.
    """
    columns = columns or data_columns(df, order_by)
    decided = decide_missing(df, columns, numeric_columns(df, columns), mode, auto)
    ways = {c: way for c, _, _, way, _ in decided}
    value = {c: F.lit(v).cast(df.schema[c].dataType) for c, _, _, way, v in decided if way == "median"}
    place = {c: i for i, c in enumerate(ways)}
    drops = [c for c, way in ways.items() if way == "drop"]
    at, = free(df, "_dropped")  # the place of the decision that drops a row
    known = df.withColumn(at, F.coalesce(*[F.when(missing(df, c), F.lit(place[c])) for c in drops], F.lit(None).cast("int")))
    filled = lambda c, when: F.when(missing(df, c) & when, value[c]).otherwise(F.col(f"`{c}`")) if c in value else F.col(f"`{c}`")
    entry = lambda c, old, new, what, why: F.struct(F.lit(c).alias("field"), old.cast("string").alias("original_value"), new.cast("string").alias("new_value"), F.lit(what).alias("operation"), F.lit(why).alias("evidence_id"))
    entries = [F.when(missing(df, c) & (F.col(at).isNull() | (F.col(at) > place[c])), entry(c, F.lit(None), value[c], "imputation", "missing_median_imputation_robust")) for c in value]
    if drops:  # one for each cell, as it was when the row was dropped
        entries += [F.when(F.col(at).isNotNull(), entry(c, filled(c, F.col(at) > place[c]) if c in value else F.col(f"`{c}`"), F.lit(None), "deletion", "missing_complete_case_analysis")) for c in columns]
    new = {c: filled(c, F.lit(True)) for c in value} | {f"{c}_missing_flag": missing(df, c) for c, way in ways.items() if way == "flag"}
    table = known.where(F.col(at).isNull()).drop(at) if drops else df
    if entries:
        cells = F.filter(F.array(*entries), lambda x: x.isNotNull())
        touched = reduce(lambda a, b: a | b, [missing(df, c) for c in [*drops, *value]])
        changes = known.where(touched).select(record_id(df, order_by).alias("record_id"), F.col(order_by).alias("row_id"), F.inline(cells))
    else:
        changes = df.sparkSession.createDataFrame([], LINEAGE)
    return table.withColumns(new) if new else table, changes, [d[:4] for d in decided]


def flag_dates(df: DataFrame) -> DataFrame:
    """df with date_inconsistency_flag: a visit before enrollment; false where either date is missing."""
    enroll, visit = (first_present(df, names, table_order=True) for names in (R.ENROLL_NAMES, R.VISIT_NAMES))
    wrong = F.coalesce(date_of(df, visit) < date_of(df, enroll), F.lit(False)) if enroll and visit else F.lit(False)
    return df.withColumn("date_inconsistency_flag", wrong)


def normalize(df: DataFrame, column: str, way: str = "z") -> DataFrame:
    """<column>_<way>: z score, logarithm of positive values, or place between least and greatest."""
    x = number(df, column)
    if way == "log":
        return df.withColumn(f"{column}_log", F.when(x > 0, F.ln(x)))
    a, s, l, h = free(df, "_a", "_s", "_l", "_h")
    one = df.agg(F.avg(x).alias(a), F.stddev_pop(x).alias(s), F.min(x).alias(l), F.max(x).alias(h))
    value = F.try_divide(x - F.col(a), F.col(s)) if way == "z" else F.try_divide(x - F.col(l), F.col(h) - F.col(l))
    return df.crossJoin(F.broadcast(one)).withColumn(f"{column}_{way}", value).drop(a, s, l, h)  # one row


def coerce(df: DataFrame, dates: list[str] = (), codes: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Text columns in one form: ISO dates, trimmed upper-case codes, numbers; what doesn't parse becomes null."""
    new = {c: F.date_format(parse_date(F.col(c).cast("string")), "yyyy-MM-dd") for c in dates}
    new |= {c: F.upper(F.trim(F.col(c).cast("string"))) for c in codes}
    new |= {c: number(df, c) for c in numbers}
    return df.withColumns(new)


def audit_row(spark, operation: str, action: str, records: Column | int, evidence: str | None = None, user: str = "tablecare", source: DataFrame | None = None) -> DataFrame:
    """One audit row; records may be an aggregate over source."""
    one = source.agg(records.alias("records_affected")) if source is not None else spark.range(1).select(F.lit(records).cast("long").alias("records_affected"))
    return one.select(F.lit(operation).alias("operation"), F.lit(action).alias("action"), F.lit(user).alias("user"), "records_affected", F.lit(evidence).cast("string").alias("evidence_id"))
