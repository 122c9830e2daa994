"""Row validation: long tables of violations from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.cells import missing

#: row_id, field, rule, severity, low, high, value
ICD10 = r"^[A-Z][0-9]{2}(\.[0-9]{1,2})?$"


def cells(df: DataFrame, fields: list[str], row_id: str = "row_id", more: list[str] = ()) -> DataFrame:
    """row_id, field, value (and more): a row for each number that is there."""
    parts = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("double").alias("value")) for f in fields]))
    return df.select(F.col(row_id).alias("row_id"), *more, parts).where("value IS NOT NULL")


def plausible(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, float(a), float(b)) for f, a, b in R.PLAUSIBLE], "field string, low double, high double")


def vital_signs(values: DataFrame, athlete: Column | None = None) -> DataFrame:
    """Violations of long cells (row_id, field, value): out of range, unknown field, and what a value points to.

    A heart rate in range is slow below 50 (not for athletes) and fast above 100; out of range, blood pressure is high
    or low; temperature is fever above 38 and hypothermia below range.
    """
    athlete = F.coalesce(athlete, F.lit(False)) if athlete is not None else F.lit(False)
    known = values.join(F.broadcast(plausible(values.sparkSession)), "field", "left")  # a fixed list
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    pressure = F.col("field").isin("systolic_bp", "diastolic_bp")
    heart = (F.col("field") == "heart_rate") & ~out
    found = F.array(
        F.when(F.col("low").isNull(), F.struct(F.lit("unknown_field").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(out, F.struct(F.lit("out_of_range").alias("rule"), F.lit("error").alias("severity"))),
        F.when(heart & (F.col("value") < 50) & ~athlete, F.struct(F.lit("bradycardia").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(heart & (F.col("value") > 100), F.struct(F.lit("tachycardia").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(out & pressure & (F.col("value") > F.col("high")), F.struct(F.lit("high_pressure").alias("rule"), F.lit("note").alias("severity"))),
        F.when(out & pressure & (F.col("value") < F.col("low")), F.struct(F.lit("low_pressure").alias("rule"), F.lit("note").alias("severity"))),
        F.when((F.col("field") == "temperature") & (F.col("value") > 38), F.struct(F.lit("fever").alias("rule"), F.lit("warning").alias("severity"))),
        F.when((F.col("field") == "temperature") & (F.col("value") < F.col("low")), F.struct(F.lit("hypothermia").alias("rule"), F.lit("note").alias("severity"))),
    )
    return known.withColumn("found", F.filter(found, lambda x: x.isNotNull())).where("size(found) > 0").select("row_id", "field", "value", "low", "high", F.inline("found")).select("row_id", "field", "rule", "severity", "low", "high", "value")


def _violations(df: DataFrame, row_id: str, field: str, value: Column, rules: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.array(*[F.when(c, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for c, rule, severity in rules])
    return df.select(F.col(row_id).alias("row_id"), F.lit(field).alias("field"), F.filter(found, lambda x: x.isNotNull()).alias("found"), value.cast("string").alias("value")).where("size(found) > 0").select("row_id", "field", F.inline("found"), "value").select("row_id", "field", "rule", "severity", "value")


def age(df: DataFrame, column: str = "age", row_id: str = "row_id") -> DataFrame:
    c = F.col(column)
    return _violations(df, row_id, column, c, [((c < 0) | (c > 120), "age_impossible", "error"), ((c > 110) & (c <= 120), "age_unlikely", "warning")])


def date_order(df: DataFrame, earlier: str, later: str, row_id: str = "row_id") -> DataFrame:
    """Text dates: an error for each side that doesn't parse, and one where the order is wrong."""
    from ..functions.cells import parse_date

    a, b = parse_date(F.col(earlier)), parse_date(F.col(later))
    return _violations(df, row_id, later, F.col(later), [(a.isNull(), "earlier_unreadable", "error"), (b.isNull(), "later_unreadable", "error"), (b < a, "wrong_order", "error")])


def bmi(df: DataFrame, weight: str = "weight", height: str = "height", row_id: str = "row_id") -> DataFrame:
    """row_id, bmi, bmi_class, severity: class of weight in kg and height in cm, or which of them is impossible."""
    w, h = F.col(weight), F.col(height)
    value = w / F.pow(h / 100, 2)
    chain = F.when((w <= 0) | (w > 300), "weight_impossible").when((h <= 0) | (h > 250), "height_impossible")
    for below, name in R.BMI_CLASSES:
        chain = chain.when(value < below, name)
    named = chain.otherwise("severely_high")
    severity = F.when(named.isin("weight_impossible", "height_impossible", "severely_low", "severely_high"), "error").when(named == "normal", "ok").otherwise("warning")
    return df.where(w.isNotNull() & h.isNotNull()).select(F.col(row_id).alias("row_id"), F.when(~named.isin("weight_impossible", "height_impossible"), value).alias("bmi"), named.alias("bmi_class"), severity.alias("severity"))


def lab_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(R.LAB)], "place int, test string, context string, unit string, low double, high double")


def lab_values(df: DataFrame) -> DataFrame:
    """row_id, test, context, rule, severity, low, high, value of (row_id, test, value, unit, fasting, sex).

    The context is fasting or random for glucose, sex where a test has ranges by sex; without it the first range holds.
    """
    wanted = F.when(F.col("fasting") == F.lit(False), "random").when(F.col("fasting"), "fasting")
    ranges = lab_ranges(df.sparkSession)
    key = [c for c in ("row_id", "test") if c in df.columns]
    joined = df.join(F.broadcast(ranges.withColumnRenamed("unit", "range_unit")), "test")  # a fixed list
    fit = F.coalesce((F.col("context") == wanted) | (F.col("context") == F.lower("sex")), F.lit(False))
    best = joined.withColumn("_place", F.row_number().over(W.partitionBy(*key).orderBy(~fit, "place"))).where("_place = 1")
    v = F.col("value")
    severe = {test: x for test, x, note in R.LAB_NOTES if note == "diabetes"}
    mild = {test: x for test, x, note in R.LAB_NOTES if note == "prediabetes"}
    at = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("test"))
    found = F.array(
        F.when(F.lower("unit") != F.lower("range_unit"), F.struct(F.lit("unit_mismatch").alias("rule"), F.lit("warning").alias("severity"))),
        F.when((v < F.col("low")) | (v > F.col("high")), F.struct(F.lit("out_of_range").alias("rule"), F.lit("error").alias("severity"))),
        F.when(v >= at(severe), F.struct(F.lit("diabetes").alias("rule"), F.lit("note").alias("severity"))).when(v >= at(mild), F.struct(F.lit("prediabetes").alias("rule"), F.lit("note").alias("severity"))),
    )
    return best.withColumn("found", F.filter(found, lambda x: x.isNotNull())).where("size(found) > 0").select("row_id", "test", "context", "low", "high", "value", F.inline("found")).select("row_id", "test", "context", "rule", "severity", "low", "high", "value")


def icd10(df: DataFrame, column: str = "icd10", row_id: str = "row_id") -> DataFrame:
    c = F.col(column)
    return _violations(df, row_id, column, c, [(~F.coalesce(F.trim(F.upper(c)).rlike(ICD10), F.lit(False)), "icd10_format", "error")])


def required(df: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """row_id, missing_fields: names of required fields that a row lacks."""
    lacking = F.filter(F.array(*[F.when(missing(df, f) if f in df.columns else F.lit(True), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return df.select(F.col(row_id).alias("row_id"), lacking.alias("missing_fields")).where("size(missing_fields) > 0")


def results(violations: DataFrame) -> DataFrame:
    """row_id, valid, n_errors, n_warnings, errors, warnings, notes: a row's violations together."""
    named = F.concat_ws(":", "field", "rule")
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("severity") == s, named)))
    return violations.groupBy("row_id").agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("valid"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.concat_ws(",", of("error")).alias("errors"), F.concat_ws(",", of("warning")).alias("warnings"), F.concat_ws(",", of("note")).alias("notes"),
    )
