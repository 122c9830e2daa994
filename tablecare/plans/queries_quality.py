"""Queries of sources, typing, profiles, quality and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import ranges as R
from ..functions.stats import group_quantiles
from ..operators import issues, profile, quality
from ..sources import files
from .fixtures import AS_OF, frame, sql
from .registry import query, rounded

V = ["patient_id", "age", "gender", "systolic_bp", "heart_rate", "temperature", "weight", "height", "lab_value", "enrollment_date", "visit_date"]
NUM = ["age", "systolic_bp", "heart_rate", "temperature", "weight", "height", "lab_value"]
BOUNDS = [("age", 0, 120), ("systolic_bp", 30, 300), ("heart_rate", 15, 250), ("temperature", 25, 45)]


def each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


def fence(c: str, p: float) -> str:
    return f"((percentile_disc({p}) WITHIN GROUP (ORDER BY {c}) + percentile_disc({1 - p}) WITHIN GROUP (ORDER BY {c} DESC)) / 2)"


NUMERIC_TEXT = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
CLEAN = "CASE WHEN lower(trim({c})) IN ('', 'na', 'null') THEN NULL ELSE {c} END"


@query(sql("cells", rest=f"SELECT row_id, {CLEAN.format(c='cell')} AS cell, {CLEAN.format(c='digits')} AS digits, words, nothing FROM cells"))
def src02_null_tokens(spark, sf_dir):
    return C.normalize_nulls(frame(spark, sf_dir, "cells"))


@query(sql("cells", rest=f"SELECT row_id, CASE WHEN regexp_matches(cell, {NUMERIC_TEXT}) THEN TRY_CAST(trim(cell) AS DOUBLE) END AS x FROM cells"))
def src03_numbers(spark, sf_dir):
    return frame(spark, sf_dir, "cells").select("row_id", C.parse_number(F.col("cell")).alias("x"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, trim(o_orderstatus) AS o_orderstatus, trim(o_orderpriority) AS o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 5")
def src06_preview(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return files.preview(orders, 5, "o_orderkey")


@query(sql("visits", rest="SELECT row_id, patient_id, age FROM visits ORDER BY row_id LIMIT 5"))
def src07_head(spark, sf_dir):
    return files.head(frame(spark, sf_dir, "visits").select("row_id", "patient_id", "age"), 5, "row_id")


@query(sql("cells", rest="SELECT row_id, cell IS NULL OR cell = '' AS cell, digits IS NULL OR digits = '' AS digits, words IS NULL OR words = '' AS words FROM cells"))
def prj01_missing(spark, sf_dir):
    df = frame(spark, sf_dir, "cells")
    return df.select("row_id", *[C.missing(df, c).alias(c) for c in ("cell", "digits", "words")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN false WHEN l_linenumber = 4 THEN false WHEN l_linenumber = 5 THEN false ELSE l_quantity IS NOT NULL END AS ok FROM lineitem")
def prj02_finite(spark, sf_dir):
    odd = F.when(F.col("l_linenumber") == 3, float("nan")).when(F.col("l_linenumber") == 4, float("inf")).when(F.col("l_linenumber") == 5, None).otherwise(F.col("l_quantity").cast("double"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", C.finite(odd).alias("ok"))


@query(sql("cells", rest=f"SELECT row_id, TRY_CAST(trim(cell) AS DOUBLE) AS x FROM cells WHERE regexp_matches(cell, {NUMERIC_TEXT})"))
def prj03_numeric_projection(spark, sf_dir):
    df = frame(spark, sf_dir, "cells")
    return df.select("row_id", C.number(df, "cell").alias("x")).where("x IS NOT NULL")


TYPES = sql("cells", rest="counts AS (" + each(["cell", "digits", "words", "nothing"], f"SELECT '{{c}}' AS \"column\", count(*) FILTER (WHERE {{c}} IS NOT NULL AND {{c}} <> '') AS cells, count(*) FILTER (WHERE regexp_matches({{c}}, {NUMERIC_TEXT})) AS numbers FROM cells") + ") SELECT \"column\", CASE WHEN cells = 0 THEN 'empty' WHEN numbers = cells THEN 'numeric' WHEN numbers = 0 THEN 'string' ELSE 'mixed' END AS col_type, cells, numbers FROM counts")


@query(TYPES)
def prj04_column_types(spark, sf_dir):
    return profile.column_types(frame(spark, sf_dir, "cells"))


@query(f"SELECT \"column\" FROM ({TYPES}) WHERE col_type = 'numeric'")
def prj05_numeric_columns(spark, sf_dir):
    return profile.column_types(frame(spark, sf_dir, "cells")).where("col_type = 'numeric'").select("column")


@query(f"SELECT \"column\" FROM ({TYPES}) WHERE col_type = 'string'")
def prj06_text_columns(spark, sf_dir):
    return profile.column_types(frame(spark, sf_dir, "cells")).where("col_type = 'string'").select("column")


@query(sql("visits", rest="SELECT row_id, patient_id, age AS patient_age, systolic_bp AS systolic, heart_rate AS pulse, CAST(enrollment_date AS VARCHAR) AS enrolled, CAST(visit_date AS VARCHAR) AS visited FROM visits"))
def prj07_aliases(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    names = {"patient_age": C.first_present(df, R.AGE_NAMES, True), "systolic": C.first_present(df, R.NORMAL[0][0]), "pulse": C.first_present(df, R.NORMAL[2][0]), "enrolled": C.first_present(df, R.ENROLL_NAMES, True), "visited": C.first_present(df, R.VISIT_NAMES, True)}
    return df.select("row_id", "patient_id", *[(F.col(c).cast("string") if n in ("enrolled", "visited") else F.col(c)).alias(n) for n, c in names.items()])


@query(sql("visits", rest=f"SELECT count(*) AS n_rows, {len(V)} AS n_columns FROM visits"))
def agg01_counts(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(profile.data_columns(df))))


@query(sql("visits", rest=each(V, "SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 6) AS missing_rate FROM visits")))
def agg02_missing_rates(spark, sf_dir):
    return rounded(profile.profile(frame(spark, sf_dir, "visits")).select("column", "n", "missing_count", "missing_rate"))


@query(sql("visits", rest=each(NUM, "SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(" + fence("{c}", 0.5) + ", 6) AS median, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM visits")))
def agg03_numeric_stats(spark, sf_dir):
    return rounded(profile.profile(frame(spark, sf_dir, "visits")).where("col_type = 'numeric'").select("column", "mean", "median", "std", "min", "max"))


QUARTERS = (0.25, 0.5, 0.75)


def _order_quantiles(spark, sf_dir, key):
    found = group_quantiles(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_custkey", key), ["o_custkey"], F.col("o_totalprice"), QUARTERS)
    return rounded(found.select("o_custkey", "n", *[F.col(f"q{i}").alias(f"q{int(100 * p)}") for i, p in enumerate(QUARTERS)]))


@query("SELECT o_custkey, count(*) AS n, " + ", ".join(f"round({fence('o_totalprice', p)}, 6) AS q{int(100 * p)}" for p in QUARTERS) + " FROM orders GROUP BY o_custkey")
def agg04_quantiles(spark, sf_dir):
    return _order_quantiles(spark, sf_dir, F.col("o_custkey"))


@query("SELECT o_custkey, count(*) AS n, " + ", ".join(f"round({fence('o_totalprice', p)}, 6) AS q{int(100 * p)}" for p in QUARTERS) + " FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders) GROUP BY o_custkey")
def agg04_hot_group(spark, sf_dir):
    """Quantiles of groups of which one, with a null key, has half of all rows."""
    return _order_quantiles(spark, sf_dir, F.when(F.col("o_orderkey") % 2 != 0, F.col("o_custkey")))


MISSING_CELLS = " + ".join(f"(count(*) - count({c}))" for c in V)
LEVEL = "CASE WHEN {s} >= 0.95 THEN 'excellent' WHEN {s} >= 0.80 THEN 'good' WHEN {s} >= 0.60 THEN 'fair' ELSE 'poor' END"
COMPLETE = f"completeness AS (SELECT count(*) AS n_rows, {MISSING_CELLS} AS missing_cells, greatest(0, 1 - ({MISSING_CELLS}) / (count(*) * {len(V)})) AS score FROM visits)"


@query(sql("visits", rest=COMPLETE + f" SELECT n_rows, missing_cells, {len(V)} AS n_columns, round(score, 6) AS score, {LEVEL.format(s='score')} AS level FROM completeness"))
def agg05_completeness(spark, sf_dir):
    return rounded(quality.completeness(frame(spark, sf_dir, "visits")))


@query(sql("visits", rest="rates AS (" + each(V, "SELECT '{c}' AS \"column\", (count(*) - count({c})) / count(*) AS missing_rate FROM visits") + ") SELECT \"column\", round(missing_rate, 6) AS missing_rate, CASE WHEN missing_rate > 0.2 THEN 'severe' ELSE 'noted' END AS finding FROM rates WHERE missing_rate > 0.05"))
def agg05_completeness_findings(spark, sf_dir):
    return rounded(quality.completeness_findings(profile.profile(frame(spark, sf_dir, "visits"))))


@query(sql("visits", rest=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({a} AS DOUBLE) AS low, CAST({b} AS DOUBLE) AS high, count(*) FILTER (WHERE {c} NOT BETWEEN {a} AND {b}) AS violations FROM visits" for c, a, b in BOUNDS)))
def agg06_range_violations(spark, sf_dir):
    return quality.range_violations(frame(spark, sf_dir, "visits"), BOUNDS)


NEGATIVE = ["age", "weight", "height", "systolic_bp", "heart_rate"]


@query(sql("visits", rest=each(NEGATIVE, "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < 0) AS negatives FROM visits")))
def agg07_negatives(spark, sf_dir):
    return quality.negatives(frame(spark, sf_dir, "visits"))


FENCES = "fences AS (" + each(NUM, "SELECT '{c}' AS \"column\", count({c}) AS n, " + fence("{c}", 0.25) + " - 3 * (" + fence("{c}", 0.75) + " - " + fence("{c}", 0.25) + ") AS low, " + fence("{c}", 0.75) + " + 3 * (" + fence("{c}", 0.75) + " - " + fence("{c}", 0.25) + ") AS high FROM visits") + ")"
EXTREMES = FENCES + ", extremes AS (" + each(NUM, "SELECT f.\"column\", f.low, f.high, (SELECT count(*) FROM visits v WHERE v.{c} < f.low OR v.{c} > f.high) AS extremes FROM fences f WHERE f.\"column\" = '{c}' AND f.n >= 4") + ")"


@query(sql("visits", rest=EXTREMES + " SELECT \"column\", round(low, 6) AS low, round(high, 6) AS high, extremes FROM extremes"))
def agg08_extremes(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    return rounded(quality.extremes(df, profile.numeric_columns(df)))


WRONG = " + ".join([f"count(*) FILTER (WHERE {c} NOT BETWEEN {a} AND {b})" for c, a, b in BOUNDS] + [f"count(*) FILTER (WHERE {c} < 0)" for c in NEGATIVE])
NEGATIVES_ONLY = " + ".join(f"count(*) FILTER (WHERE {c} < 0)" for c in NEGATIVE)


def _validity(wrong: str) -> str:
    return EXTREMES + f", validity AS (SELECT count(*) AS n_rows, {wrong} AS invalid, (SELECT CAST(sum(extremes) AS BIGINT) FROM extremes) AS outliers, {len(NUM)} AS n_numeric FROM visits)"


VALID = "greatest(0, 1 - (invalid + outliers) / (n_rows * n_numeric))"


@query(sql("visits", rest=_validity(WRONG) + f" SELECT *, round({VALID}, 6) AS score, {LEVEL.format(s=VALID)} AS level FROM validity"))
def agg09_validity(spark, sf_dir):
    return rounded(quality.validity(frame(spark, sf_dir, "visits"), bounds=BOUNDS))


BMI_WRONG = "height > 0 AND abs(weight / power(CASE WHEN height > 3 THEN height / 100 ELSE height END, 2) - bmi) > 2"


@query(sql("patients", rest=f"SELECT count(*) FILTER (WHERE {BMI_WRONG}) AS bmi_errors FROM patients"))
def agg10_bmi(spark, sf_dir):
    df = frame(spark, sf_dir, "patients")
    return df.agg(quality.bmi_errors(df).alias("bmi_errors"))


@query(sql("patients", rest=" UNION ALL ".join(f"SELECT '{a}' AS earlier, '{b}' AS later, count(*) FILTER (WHERE {b} < {a}) AS errors FROM patients" for a, b in R.DATE_PAIRS)))
def agg11_date_pairs(spark, sf_dir):
    df = frame(spark, sf_dir, "patients")
    found = quality.order_errors(df)
    one = df.agg(*[c.alias(f"e{i}") for i, (_, _, c) in enumerate(found)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"e{i}").alias("errors")) for i, (a, b, _) in enumerate(found)])))


AGE_WRONG = "abs((DATE '2024-06-01' - birth_date) / 365.25 - age) > 2"


@query(sql("patients", rest=f"SELECT count(*) FILTER (WHERE {AGE_WRONG}) AS age_errors FROM patients"))
def agg12_age_birth(spark, sf_dir):
    df = frame(spark, sf_dir, "patients")
    return df.agg(quality.age_errors(df, AS_OF).alias("age_errors"))


ORDER_WRONG = " + ".join(f"count(*) FILTER (WHERE {b} < {a})" for a, b in R.DATE_PAIRS)


@query(sql("patients", rest=f"c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE {BMI_WRONG}) AS bmi_errors, {ORDER_WRONG} AS date_errors, count(*) FILTER (WHERE {AGE_WRONG}) AS age_errors FROM patients), s AS (SELECT *, greatest(0, 1 - (bmi_errors + date_errors + age_errors) / n_rows) AS x FROM c) SELECT n_rows, bmi_errors, date_errors, age_errors, round(x, 6) AS score, {LEVEL.format(s='x')} AS level FROM s"))
def agg13_consistency(spark, sf_dir):
    return rounded(quality.consistency(frame(spark, sf_dir, "patients"), AS_OF))


CELLS_OF = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in V)


@query(sql("visits", rest=f"SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS_OF} FROM visits)) AS duplicates FROM visits"))
def agg14_exact_duplicates(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    return quality.duplicates(df, profile.data_columns(df))


@query(sql("visits", rest="SELECT count(*) AS n_rows, count(*) - count(DISTINCT coalesce(patient_id, '')) AS duplicates FROM visits"))
def agg15_key_duplicates(spark, sf_dir):
    return quality.duplicates(frame(spark, sf_dir, "visits"), ["patient_id"])


KEYS_OF = "coalesce(patient_id, ''), coalesce(CAST(visit_date AS VARCHAR), '')"


@query(sql("visits", rest=f"SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {KEYS_OF} FROM visits)) AS duplicates FROM visits"))
def agg16_composite_duplicates(spark, sf_dir):
    return quality.duplicates(frame(spark, sf_dir, "visits"), ["patient_id", "visit_date"])


UNIQUE = f"u AS (SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS_OF} FROM visits)) AS exact_duplicates, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {KEYS_OF} FROM visits)) AS composite_duplicates FROM visits)"


@query(sql("visits", rest=UNIQUE + f", s AS (SELECT *, greatest(0, 1 - (exact_duplicates + composite_duplicates) / n_rows) AS x FROM u) SELECT n_rows, exact_duplicates, composite_duplicates, round(x, 6) AS score, {LEVEL.format(s='x')} AS level FROM s"))
def agg17_uniqueness(spark, sf_dir):
    return rounded(quality.uniqueness(frame(spark, sf_dir, "visits"), keys=["patient_id", "visit_date"]))


PATIENT_DATES = ["enrollment_date", "visit_date", "completion_date", "birth_date"]


@query(sql("patients", rest="t AS (SELECT count(*) AS n_rows, " + " + ".join(f"count(*) FILTER (WHERE {c} > DATE '2024-06-01')" for c in PATIENT_DATES) + f" AS future_dates FROM patients), s AS (SELECT *, greatest(0, 1 - future_dates / n_rows) AS x FROM t) SELECT n_rows, future_dates, round(x, 6) AS score, {LEVEL.format(s='x')} AS level FROM s"))
def agg18_timeliness(spark, sf_dir):
    df = frame(spark, sf_dir, "patients")
    return rounded(quality.timeliness(df, quality.known_dates(df), AS_OF))


@query(sql("patients", rest="a AS (" + each(PATIENT_DATES, "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} > DATE '2024-06-01') AS future, CAST(round(avg(CASE WHEN {c} <= DATE '2024-06-01' THEN DATE '2024-06-01' - {c} END)) AS BIGINT) AS mean_age_days FROM patients") + ") SELECT *, coalesce(mean_age_days > 1825, false) AS stale FROM a"))
def agg19_date_ages(spark, sf_dir):
    df = frame(spark, sf_dir, "patients")
    return quality.date_ages(df, quality.known_dates(df), AS_OF)


REPORT = (
    COMPLETE + ", " + _validity(NEGATIVES_ONLY) + f""", k AS (SELECT count(*) FILTER (WHERE visit_date < enrollment_date) AS wrong FROM visits),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS_OF} FROM visits)) AS twice FROM visits),
f AS (SELECT count(*) FILTER (WHERE enrollment_date > DATE '2024-06-01') + count(*) FILTER (WHERE visit_date > DATE '2024-06-01') AS future FROM visits),
parts AS (SELECT c.n_rows, c.score AS completeness, greatest(0, 1 - (invalid + outliers) / (v.n_rows * n_numeric)) AS validity, greatest(0, 1 - wrong / c.n_rows) AS consistency,
  greatest(0, 1 - twice / c.n_rows) AS uniqueness, greatest(0, 1 - future / c.n_rows) AS timeliness FROM completeness c, validity v, k, d, f),
report AS (SELECT *, 0.25 * completeness + 0.25 * validity + 0.2 * consistency + 0.2 * uniqueness + 0.1 * timeliness AS overall FROM parts)"""
)


@query(sql("visits", rest=REPORT + f" SELECT 'visits' AS dataset_name, n_rows, {len(V)} AS n_columns, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(consistency, 6) AS consistency, round(uniqueness, 6) AS uniqueness, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall, {LEVEL.format(s='overall')} AS level FROM report"))
def agg20_quality_report(spark, sf_dir):
    return rounded(quality.assess(frame(spark, sf_dir, "visits"), AS_OF, "visits"))


@query(sql("visits", rest=REPORT + ", dims AS (" + each(["completeness", "validity", "consistency", "uniqueness", "timeliness"], "SELECT '{c}' AS dimension, {c} AS score FROM report") + f") SELECT dimension, round(score, 6) AS score, {LEVEL.format(s='score')} AS level FROM dims"))
def agg21_levels(spark, sf_dir):
    return rounded(quality.dimension_rows(quality.assess(frame(spark, sf_dir, "visits"), AS_OF, "visits")))


@query(sql("visits", rest=each(["patient_id", "enrollment_date", "visit_date"], "SELECT '{c}' AS \"column\", CASE WHEN '{c}' = 'patient_id' THEN 'key' ELSE 'date' END AS role, count(*) AS n, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS different FROM visits")))
def agg22_discovery(spark, sf_dir):
    """Columns found to be keys and dates, with their rows, gaps and different values."""
    df = frame(spark, sf_dir, "visits")
    return quality.discover(df)


@query(sql("visits", rest="d AS (" + each(NUM, "SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, " + fence("{c}", 0.5) + " AS median, stddev_pop({c}) AS std, skewness({c}) AS skewness, kurtosis({c}) AS excess_kurtosis FROM visits") + ") SELECT \"column\", n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(skewness, 6) AS skewness, round(excess_kurtosis, 6) AS excess_kurtosis, abs(skewness) < 2 AND abs(excess_kurtosis - 3) < 7 AS near_normal FROM d WHERE n >= 4"))
def agg23_distribution(spark, sf_dir):
    return rounded(profile.distribution(frame(spark, sf_dir, "visits"), NUM))


def _mcar() -> str:
    parts = []
    for c in V:
        pairs = " UNION ALL ".join(f"SELECT abs(corr(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END, {n})) AS r, count({n}) AS k FROM visits" for n in NUM if n != c)
        parts.append(f"SELECT '{c}' AS \"column\", (SELECT count(*) - count({c}) FROM visits) AS missing_count, (SELECT avg(r) FROM ({pairs}) WHERE k >= 10 AND r IS NOT NULL AND NOT isnan(r)) AS m")
    return "g AS (" + " UNION ALL ".join(parts) + ") "


@query(sql("visits", rest=_mcar() + "SELECT \"column\", missing_count, CASE WHEN missing_count > 0 THEN round(m, 6) END AS mean_correlation, missing_count = 0 OR coalesce(m < 0.1, true) AS mcar FROM g"))
def agg24_mcar(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    return rounded(issues.gap_statistics(df, V, NUM).drop("rows"))


def _issues() -> str:
    none = "CAST(NULL AS DOUBLE)"
    rows = ["SELECT 0 AS ordinal, 'critical' AS severity, 'missing_identifier' AS category, 'patient_id' AS field, 'missing' AS code, count(*) FILTER (WHERE patient_id IS NULL) AS count, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS evidence_id, CAST(NULL AS BOOLEAN) AS mcar FROM visits"]
    for i, (c, a, b, rule) in enumerate([("systolic_bp", 90, 120, "vs_blood_pressure_normal"), ("heart_rate", 60, 100, "vs_heart_rate_normal"), ("temperature", 36.1, 37.2, "vs_temperature_normal")], 1):
        rows.append(f"SELECT {10 * i}, 'medium', 'vital_signs', '{c}', 'out_of_range', count(*) FILTER (WHERE {c} NOT BETWEEN CAST({a} AS DOUBLE) AND CAST({b} AS DOUBLE)), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), '{rule}', NULL FROM visits")
    rows.append("SELECT 40, 'high', 'demographics', 'age', 'out_of_range', count(*) FILTER (WHERE age NOT BETWEEN 0 AND 120), 0.0, 120.0, NULL, NULL FROM visits")
    rows.append(f"SELECT 50, 'high', 'date_consistency', 'visit_date', 'before_enrollment', count(*) FILTER (WHERE visit_date < enrollment_date), {none}, {none}, NULL, NULL FROM visits")
    rows.append(f"SELECT 5, 'high', 'duplicates', 'patient_id,visit_date', 'duplicate_visit', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {KEYS_OF} FROM visits)), {none}, {none}, 'duplicate_exact_matches', NULL FROM visits")
    gaps = "SELECT CASE g.\"column\" " + " ".join(f"WHEN '{c}' THEN {1001 + i}" for i, c in enumerate(V)) + f" END, CASE WHEN share > 0.2 THEN 'critical' WHEN share > 0.05 THEN 'high' ELSE 'medium' END, 'missing_data', \"column\", 'missing', missing_count, {none}, {none}, CASE WHEN share < 0.05 AND mcar THEN 'missing_complete_case_analysis' ELSE 'missing_mean_imputation_caution' END, mcar FROM (SELECT \"column\", missing_count, missing_count / (SELECT count(*) FROM visits) AS share, missing_count = 0 OR coalesce(m < 0.1, true) AS mcar FROM g) g"
    return _mcar() + ", found AS (" + " UNION ALL ".join([*rows, gaps]) + "), issues AS (SELECT * FROM found WHERE count > 0) "


ISSUES = _issues()
RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


@query(sql("visits", rest=ISSUES + "SELECT severity, count(*) AS n FROM issues GROUP BY severity"))
def agg25_severity_tally(spark, sf_dir):
    return issues.tally(issues.detect(frame(spark, sf_dir, "visits")))


def _issue_query(code: str, where: str):
    def run(spark, sf_dir):
        return issues.detect(frame(spark, sf_dir, "visits")).where(where).drop("ordinal")

    run.__name__ = code
    query(sql("visits", rest=ISSUES + f"SELECT severity, category, field, code, count, low, high, evidence_id, mcar FROM issues WHERE {where}"))(run)


_issue_query("iss01_missing_identifier", "category = 'missing_identifier'")
_issue_query("iss02_duplicate_visits", "category = 'duplicates'")
_issue_query("iss03_vital_signs", "category = 'vital_signs'")
_issue_query("iss04_age", "category = 'demographics'")
_issue_query("iss05_dates", "category = 'date_consistency'")
_issue_query("iss06_missing_data", "category = 'missing_data'")


@query(sql("visits", rest=" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} NOT BETWEEN 90 AND 120) AS count FROM visits" for c in ("systolic_bp", "heart_rate", "temperature"))))
def iss03_first_range_compat(spark, sf_dir):
    return issues.detect(frame(spark, sf_dir, "visits"), compat=True).where("category = 'vital_signs'").select("field", "count")


@query(sql("visits", rest=ISSUES + f"SELECT CAST(row_number() OVER (ORDER BY {RANK}, ordinal) AS INTEGER) AS place, severity, field, code FROM issues"))
def iss07_by_severity(spark, sf_dir):
    from pyspark.sql import Window as W

    found = issues.detect(frame(spark, sf_dir, "visits"))  # as many rows as columns and rules
    return found.withColumn("place", F.row_number().over(W.orderBy(issues.severity_rank(), "ordinal"))).select("place", "severity", "field", "code")


@query(sql("visits", rest=ISSUES + f"SELECT severity, field, code, count FROM issues ORDER BY {RANK}, ordinal LIMIT 5"))
def iss08_top_issues(spark, sf_dir):
    return issues.first(issues.detect(frame(spark, sf_dir, "visits")), 5).select("severity", "field", "code", "count")
