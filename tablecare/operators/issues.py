"""Issues of a clinical table: one row each, from one wide aggregate and one pass for gaps and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.cells import date_of, first_present, missing, number
from .gaps import held
from .profile import data_columns, numeric_columns
from .quality import duplicates

SEVERITIES = ("critical", "high", "medium", "low", "info")


def gap_statistics(df: DataFrame, gaps: list[str], numbers: list[str]) -> DataFrame:
    """column, missing_count, mean_correlation, mcar, rows: whether a column's gaps look random against the numbers.

    The mean |correlation| of the gap marker with every other number column of ten values or more; gaps count as random
    below 0.1, with fewer than ten rows, without gaps or without any correlation. Two passes for any number of columns.
    """
    found = held(df, gaps, numbers)
    out = [(found.rows, c, found.missing[c], found.correlation(c), found.random(c)) for c in gaps]
    return df.sparkSession.createDataFrame(out, "rows long, column string, missing_count long, mean_correlation double, mcar boolean")


def detect(df: DataFrame, columns: list[str] | None = None, compat: bool = False) -> DataFrame:
    """ordinal, severity, category, field, code, count, low, high, evidence_id, mcar: every issue that has a count.

    compat gives all vital signs the first range, as an any-tag lookup finds it.
    """
    columns = columns or data_columns(df)
    parts: list[tuple[str, str, str, str, Column, float | None, float | None, str | None]] = []
    if "patient_id" in columns:
        parts.append(("critical", "missing_identifier", "patient_id", "missing", F.count_if(missing(df, "patient_id")), None, None, None))
    for names, low, high, rule in R.NORMAL:
        if c := first_present(df, names):
            low, high, rule = (90, 120, "vs_blood_pressure_normal") if compat else (low, high, rule)
            parts.append(("medium", "vital_signs", c, "out_of_range", F.count_if(~number(df, c).between(low, high)), float(low), float(high), rule))
    if c := first_present(df, R.AGE_NAMES, table_order=True):
        parts.append(("high", "demographics", c, "out_of_range", F.count_if(~number(df, c).between(0, 120)), 0.0, 120.0, None))
    enroll, visit = (first_present(df, names, table_order=True) for names in (R.ENROLL_NAMES, R.VISIT_NAMES))
    if enroll and visit:
        parts.append(("high", "date_consistency", visit, "before_enrollment", F.count_if(date_of(df, visit) < date_of(df, enroll)), None, None, None))
    one = df.agg(*[p[4].alias(f"c{i}") for i, p in enumerate(parts)])
    rows = [F.struct(F.lit(10 * i).alias("ordinal"), F.lit(s).alias("severity"), F.lit(cat).alias("category"), F.lit(field).alias("field"), F.lit(code).alias("code"), F.col(f"c{i}").alias("count"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.lit(rule).cast("string").alias("evidence_id"), F.lit(None).cast("boolean").alias("mcar")) for i, (s, cat, field, code, _, low, high, rule) in enumerate(parts)]
    issues = one.select(F.inline(F.array(*rows)))
    if {"patient_id", "visit_date"} <= set(columns):
        twice = duplicates(df, ["patient_id", "visit_date"]).select(F.lit(5).alias("ordinal"), F.lit("high").alias("severity"), F.lit("duplicates").alias("category"), F.lit("patient_id,visit_date").alias("field"), F.lit("duplicate_visit").alias("code"), F.col("duplicates").alias("count"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("duplicate_exact_matches").alias("evidence_id"), F.lit(None).cast("boolean").alias("mcar"))
        issues = issues.union(twice)
    gaps = gap_statistics(df, columns, numeric_columns(df, columns))
    share = F.col("missing_count") / F.col("rows")
    severity = F.when(share > R.MISSING_SEVERE, "critical").when(share > R.MISSING_NOTED, "high").otherwise("medium")
    rule = F.when(F.lit(compat), "missing_mean_imputation_caution").when((share < R.DROP_BELOW) & F.col("mcar"), "missing_complete_case_analysis").otherwise("missing_mean_imputation_caution")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int")
    gaps = gaps.select((place + 1000).alias("ordinal"), severity.alias("severity"), F.lit("missing_data").alias("category"), F.col("column").alias("field"), F.lit("missing").alias("code"), F.col("missing_count").alias("count"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), rule.alias("evidence_id"), "mcar")
    return issues.union(gaps).where("count > 0")


def severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(c))


def by_severity(issues: DataFrame) -> DataFrame:
    """Issues worst first, in order of detection within a severity."""
    return issues.orderBy(severity_rank(), "ordinal")


def first(issues: DataFrame, k: int = 20) -> DataFrame:
    return by_severity(issues).limit(k)


def tally(issues: DataFrame) -> DataFrame:
    """severity, n."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


#: Rule category of each issue category.
ADVICE = {"missing_data": "missing_data", "duplicates": "duplicates", "vital_signs": "outliers", "demographics": "outliers"}


def findings(issues: DataFrame) -> DataFrame:
    """finding_id, category, facts: the first issue of each category that rules advise on."""
    known = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    one = issues.withColumn("advice", F.try_element_at(known, F.col("category"))).where("advice IS NOT NULL")
    one = one.groupBy("advice").agg(F.min_by(F.struct("field", "mcar"), "ordinal").alias("i"))
    return one.select(F.col("advice").alias("finding_id"), F.col("advice").alias("category"), F.map_from_arrays(F.array(F.lit("mcar_assumption")), F.array(F.coalesce(F.col("i.mcar").cast("double"), F.lit(0.0)))).alias("facts"))
