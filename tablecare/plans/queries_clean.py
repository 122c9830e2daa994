"""Queries of cleaning, lineage, audit, options and privacy."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.storage import fresh_path
from ..operators import clean, lineage, pipeline, quality
from ..sources import files, publish
from .fixtures import AS_OF, frame, sql
from .queries_quality import CELLS_OF, KEYS_OF, LEVEL, NUM, REPORT, V, _mcar, each, fence
from .registry import query, rounded

# Dates as text, so that engines agree on them.
COLUMNS = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("_date") else c for c in V)


def plain(df):
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c.endswith("_date")})


def dedupe(keep: str = "ASC", source: str = "visits") -> str:
    """CTEs exact (rows with their place), left1, comp, kept."""
    return f"""exact AS (SELECT *, row_number() OVER (PARTITION BY {CELLS_OF} ORDER BY row_id {keep}) AS place FROM {source}),
left1 AS (SELECT * EXCLUDE (place) FROM exact WHERE place = 1),
comp AS (SELECT *, row_number() OVER (PARTITION BY {KEYS_OF} ORDER BY row_id {keep}) AS place FROM left1),
kept AS (SELECT * EXCLUDE (place) FROM comp WHERE place = 1),
gone AS (SELECT * FROM exact WHERE place > 1 UNION ALL SELECT * FROM comp WHERE place > 1)"""


@query(sql("visits", rest=dedupe() + f" SELECT row_id, {COLUMNS} FROM left1"))
def cln01_exact_dedupe(spark, sf_dir):
    return plain(clean.drop_duplicates(frame(spark, sf_dir, "visits"), [])[0])


@query(sql("visits", rest=dedupe() + f" SELECT row_id, {COLUMNS} FROM kept"))
def cln02_composite_dedupe(spark, sf_dir):
    return plain(clean.drop_duplicates(frame(spark, sf_dir, "visits"))[0])


@query(sql("visits", rest=dedupe("DESC") + f" SELECT row_id, {COLUMNS} FROM kept"))
def cln02_keep_last(spark, sf_dir):
    return plain(clean.drop_duplicates(frame(spark, sf_dir, "visits"), keep="last")[0])


# Doubles are compared as numbers: engines write them differently.
LINEAGE_VALUE = "CASE WHEN field IN ('age', 'systolic_bp', 'heart_rate', 'temperature', 'weight', 'height', 'lab_value') THEN CAST(CAST({v} AS DOUBLE) AS BIGINT) END AS {v}"
RECORD = "coalesce(patient_id, 'row_' || CAST(row_id AS VARCHAR))"


@query(sql("visits", rest=dedupe() + ", cells AS (" + each(V, f"SELECT {RECORD} AS record_id, row_id, '{{c}}' AS field, CAST({{c}} AS VARCHAR) AS original_value FROM gone") + ") SELECT record_id, row_id, field, CASE WHEN field IN ('patient_id', 'gender', 'enrollment_date', 'visit_date') THEN original_value ELSE CAST(CAST(round(CAST(original_value AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) END AS original_value, 'deletion' AS operation FROM cells"))
def cln03_deletion_lineage(spark, sf_dir):
    found = clean.deletion_lineage(clean.drop_duplicates(frame(spark, sf_dir, "visits"))[1])
    plain = F.col("field").isin("patient_id", "gender", "enrollment_date", "visit_date")
    value = F.when(plain, F.col("original_value")).otherwise(F.round(F.col("original_value").try_cast("double") * 100).cast("long").cast("string"))
    return found.select("record_id", "row_id", "field", value.alias("original_value"), "operation")


@query(sql("visits", rest=_mcar() + ", d AS (SELECT \"column\", missing_count, missing_count / (SELECT count(*) FROM visits) AS rate, missing_count = 0 OR coalesce(m < 0.1, true) AS mcar FROM g) SELECT \"column\", missing_count, round(rate, 6) AS missing_rate, mcar, CASE WHEN missing_count = 0 THEN 'no_action' WHEN rate < 0.05 AND mcar THEN 'drop' WHEN rate < 0.2 THEN CASE WHEN \"column\" IN (" + ", ".join(f"'{c}'" for c in NUM) + ") THEN 'median' ELSE 'flag' END ELSE 'flag' END AS strategy FROM d"))
def cln04_missing_strategy(spark, sf_dir):
    return rounded(clean.missing_decisions(frame(spark, sf_dir, "visits"), V))


@query(sql("visits", rest=f"SELECT row_id, {COLUMNS} FROM visits WHERE age IS NOT NULL"))
def cln05_drop_missing(spark, sf_dir):
    return plain(clean.drop_missing(frame(spark, sf_dir, "visits"), "age"))


@query(sql("visits", rest=f"m AS (SELECT {fence('temperature', 0.5)} AS x FROM visits) SELECT row_id, round(coalesce(temperature, x), 6) AS temperature FROM visits, m"))
def cln06_median_impute(spark, sf_dir):
    df = frame(spark, sf_dir, "visits").select("row_id", "temperature")
    return rounded(clean.impute(df, "temperature", clean.center(df, "temperature"))[0])


@query(sql("visits", rest=f"m AS (SELECT {fence('temperature', 0.5)} AS x FROM visits) SELECT {RECORD} AS record_id, row_id, 'temperature' AS field, round(x, 6) AS new_value, 'imputation' AS operation FROM visits, m WHERE temperature IS NULL"))
def cln06_imputation_lineage(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    found = clean.impute(df, "temperature", clean.center(df, "temperature"))[1]
    return rounded(found.select("record_id", "row_id", "field", F.col("new_value").cast("double").alias("new_value"), "operation"))


@query(sql("visits", rest="SELECT row_id, heart_rate, heart_rate IS NULL AS heart_rate_missing_flag FROM visits"))
def cln07_missing_flag(spark, sf_dir):
    return clean.flag_missing(frame(spark, sf_dir, "visits").select("row_id", "heart_rate"), "heart_rate")


IMPOSSIBLE = {"age": (0, 120), "systolic_bp": (30, 300), "heart_rate": (15, 250), "temperature": (25, 45), "weight": (0.3, 500), "height": (20, 280)}
CAP = f"c AS (SELECT {fence('lab_value', 0.25)} AS q1, {fence('lab_value', 0.75)} AS q3, count(lab_value) AS n FROM {{t}})"
CAPPED = "CASE WHEN n < 4 OR q1 = q3 THEN lab_value WHEN lab_value < q1 - 3 * (q3 - q1) THEN q1 - 3 * (q3 - q1) WHEN lab_value > q3 + 3 * (q3 - q1) THEN q3 + 3 * (q3 - q1) ELSE lab_value END"
FIXED = ", ".join(f"CASE WHEN {c} BETWEEN CAST({a} AS DOUBLE) AND CAST({b} AS DOUBLE) THEN {c} END AS {c}" for c, (a, b) in IMPOSSIBLE.items())


@query(sql("visits", rest=CAP.format(t="visits") + f" SELECT row_id, {FIXED}, round({CAPPED}, 6) AS lab_value FROM visits, c"))
def cln08_fix_outliers(spark, sf_dir):
    return rounded(clean.fix_outliers(frame(spark, sf_dir, "visits"))[0].select("row_id", *IMPOSSIBLE, "lab_value"))


#: Cells of a table t that outlier handling changes: impossible ones become null, laboratory values beyond the fences are capped.
CORRECTIONS = " UNION ALL ".join(f"SELECT {RECORD} AS record_id, row_id, '{c}' AS field, {c} AS original_value, CAST(NULL AS DOUBLE) AS new_value, 'outlier_biological_plausibility' AS evidence_id FROM {{t}} WHERE {c} NOT BETWEEN CAST({a} AS DOUBLE) AND CAST({b} AS DOUBLE)" for c, (a, b) in IMPOSSIBLE.items()) + (
    f" UNION ALL SELECT {RECORD}, row_id, 'lab_value', lab_value, {CAPPED}, 'outlier_iqr_method' FROM {{t}}, c WHERE n >= 4 AND q1 <> q3 AND {CAPPED} <> lab_value"
)


@query(sql("visits", rest=CAP.format(t="visits") + ", found AS (" + CORRECTIONS.format(t="visits") + ") SELECT record_id, row_id, field, original_value, round(new_value, 6) AS new_value, evidence_id FROM found"))
def cln08_correction_lineage(spark, sf_dir):
    found = clean.fix_outliers(frame(spark, sf_dir, "visits"))[1]
    return rounded(found.select("record_id", "row_id", "field", F.col("original_value").cast("double").alias("original_value"), F.col("new_value").cast("double").alias("new_value"), "evidence_id"))


# Line prices have a longer tail than order totals: fences cap some of them.
EVENT_CAP = f"c AS (SELECT {fence('value', 0.25)} AS q1, {fence('value', 0.75)} AS q3 FROM (SELECT power(value, 3) AS value FROM events))"


@query(f"WITH {EVENT_CAP} SELECT event_id, round(CASE WHEN power(value, 3) > q3 + 3 * (q3 - q1) THEN q3 + 3 * (q3 - q1) WHEN power(value, 3) < q1 - 3 * (q3 - q1) THEN q1 - 3 * (q3 - q1) ELSE power(value, 3) END, 2) AS value FROM events, c")
def cln09_cap_outliers(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.pow("value", F.lit(3)).alias("value"))
    return rounded(clean.fix_outliers(events.withColumn("row_id", F.col("event_id")).drop("event_id"))[0].select(F.col("row_id").alias("event_id"), "value"), 2)


@query(sql("visits", rest="SELECT row_id, coalesce(visit_date < enrollment_date, false) AS date_inconsistency_flag FROM visits"))
def cln10_date_flags(spark, sf_dir):
    return clean.flag_dates(frame(spark, sf_dir, "visits")).select("row_id", "date_inconsistency_flag")


@query(sql("visits", rest=dedupe() + f", fixed AS (SELECT row_id, patient_id, gender, lab_value, enrollment_date, visit_date, {FIXED} FROM kept) SELECT count(*) AS n, count(patient_id) AS patient_id, count(age) AS age, count(heart_rate) AS heart_rate, count(systolic_bp) AS systolic_bp FROM fixed"))
def cln11_before_gaps(spark, sf_dir):
    kept, _ = clean.drop_duplicates(frame(spark, sf_dir, "visits"))
    fixed, _ = clean.fix_outliers(kept)
    return fixed.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in ("patient_id", "age", "heart_rate", "systolic_bp")])


def whole_clean() -> str:
    """CTEs kept, gone, t0 (outliers handled), for each column s<i> (its decision) and t<i+1>, and done (dates flagged)."""
    parts = [dedupe(), CAP.format(t="kept"), f"t0 AS MATERIALIZED (SELECT row_id, patient_id, gender, {FIXED}, {CAPPED} AS lab_value, enrollment_date, visit_date FROM kept, c)"]
    for i, c in enumerate(V):
        pairs = " UNION ALL ".join(f"SELECT abs(corr(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END, {n})) AS r, count({n}) AS k FROM t{i}" for n in NUM if n != c)
        middle = fence(c, 0.5) if c in NUM else "CAST(NULL AS DOUBLE)"
        way = "'median'" if c in NUM else "'flag'"
        parts.append(f"""d{i} AS (SELECT count(*) AS n, count(*) - count({c}) AS gaps, {middle} AS middle, (SELECT avg(r) FROM ({pairs}) WHERE k >= 10 AND r IS NOT NULL AND NOT isnan(r)) AS m FROM t{i})""")
        parts.append(f"""s{i} AS MATERIALIZED (SELECT *, CASE WHEN gaps = 0 THEN 'no_action' WHEN gaps / n < 0.05 AND (n < 10 OR coalesce(m < 0.1, true)) THEN 'drop' WHEN gaps / n < 0.2 THEN {way} ELSE 'flag' END AS way FROM d{i})""")
        filled = f"CASE WHEN way = 'median' THEN coalesce({c}, middle) ELSE {c} END" if c in NUM else c
        flags = [f"{x}_missing_flag" for x in V[:i]]
        others = [x for x in ["row_id", *V, *flags] if x != c]
        parts.append(f"""t{i + 1} AS MATERIALIZED (SELECT {', '.join(others)}, {filled} AS {c}, CASE WHEN way = 'flag' THEN {c} IS NULL END AS {c}_missing_flag FROM t{i}, s{i} WHERE NOT (way = 'drop' AND {c} IS NULL))""")
    parts.append(f"done AS (SELECT *, coalesce(visit_date < enrollment_date, false) AS date_inconsistency_flag FROM t{len(V)})")
    return ", ".join(parts)


FLAGS = [f"{c}_missing_flag" for c in V]


@query(sql("visits", rest=whole_clean() + f" SELECT row_id, {COLUMNS.replace('lab_value', 'round(lab_value, 6) AS lab_value')}, {', '.join(FLAGS)}, date_inconsistency_flag FROM done"))
def cln11_pipeline(spark, sf_dir):
    """The cleaned visits; a column that is not flagged has null flags."""
    table = pipeline.run(frame(spark, sf_dir, "visits"), AS_OF).table
    table = table.withColumns({c: F.lit(None).cast("boolean") for c in FLAGS if c not in table.columns})
    return rounded(plain(table.select("row_id", *V, *FLAGS, "date_inconsistency_flag")))


WAYS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", gaps, way FROM s{i}" for i, c in enumerate(V))
LINEAGE_SIZE = f"(SELECT count(*) FROM gone) * {len(V)} + (SELECT count(*) FROM corrected) + (SELECT coalesce(sum(CASE way WHEN 'drop' THEN gaps * {len(V)} WHEN 'median' THEN gaps ELSE 0 END), 0) FROM ways)"
AFTER = REPORT.replace("FROM visits v ", "FROM done v ").replace("FROM visits)", "FROM done)").replace("FROM visits", "FROM done")
for _name in ("completeness", "fences", "extremes", "validity", "k", "d", "f", "parts", "report"):
    AFTER = re.sub(rf"\b{_name} AS \(", f"{_name}_after AS (", AFTER)
    AFTER = re.sub(rf"\bFROM {_name}\b", f"FROM {_name}_after", AFTER)
AFTER = AFTER.replace("FROM completeness_after c, validity v, k, d, f", "FROM completeness_after c, validity_after v, k_after, d_after, f_after").replace("FROM fences_after f", "FROM fences_after f")
#: Flags of the cleaned table are cells too; none is missing.
N_FLAGS = "(1 + (SELECT count(*) FILTER (WHERE way = 'flag') FROM ways))"
AFTER = AFTER.replace(f"(count(*) * {len(V)})", f"(count(*) * ({len(V)} + {N_FLAGS}))")


@query(sql("visits", rest=whole_clean() + f", ways AS ({WAYS}), corrected AS (" + CORRECTIONS.format(t="kept") + "), " + REPORT + ", " + AFTER + f""" SELECT b.n_rows AS rows_in, a.n_rows AS rows_out, b.n_rows - a.n_rows AS rows_removed, round(b.overall, 6) AS score_before, round(a.overall, 6) AS score_after, round(a.overall - b.overall, 6) AS improvement,
round((a.overall - b.overall) * 100 / b.overall, 6) AS improvement_percent, {LEVEL.format(s='b.overall')} AS level_before, {LEVEL.format(s='a.overall')} AS level_after, CAST(3 + (SELECT count(*) FROM ways WHERE gaps > 0) AS INTEGER) AS operation_count, CAST({LINEAGE_SIZE} AS BIGINT) AS lineage_count FROM report b, report_after a"""))
def agg26_before_after(spark, sf_dir):
    return rounded(pipeline.run(frame(spark, sf_dir, "visits"), AS_OF).report)


@query(sql("visits", rest=whole_clean() + f", ways AS ({WAYS}), corrected AS (" + CORRECTIONS.format(t="kept") + f") SELECT operation, CAST(n AS BIGINT) AS n FROM (SELECT 'deletion' AS operation, (SELECT count(*) FROM gone) * {len(V)} + (SELECT coalesce(sum(gaps), 0) FROM ways WHERE way = 'drop') * {len(V)} AS n UNION ALL SELECT 'correction', (SELECT count(*) FROM corrected) UNION ALL SELECT 'imputation', (SELECT coalesce(sum(gaps), 0) FROM ways WHERE way = 'median')) WHERE n > 0"))
def cln11_lineage(spark, sf_dir):
    """Cells in the lineage of the whole clean, by what was done to them."""
    return pipeline.run(frame(spark, sf_dir, "visits"), AS_OF).lineage.groupBy("operation").agg(F.count("*").alias("n"))


@query(sql("visits", rest=dedupe() + f""", total AS (SELECT count(*) AS n, (SELECT count(*) FROM kept) AS k FROM visits),
a AS (SELECT 1 - (SELECT ({' + '.join(f'(count(*) - count({c}))' for c in V)}) / (count(*) * {len(V)}) FROM visits) AS x), b AS (SELECT 1 - (SELECT ({' + '.join(f'(count(*) - count({c}))' for c in V)}) / (count(*) * {len(V)}) FROM kept) AS y)
SELECT n AS rows_in, k AS rows_out, n - k AS rows_removed, round(x, 6) AS score_before, round(y, 6) AS score_after, round(y - x, 6) AS improvement, round((y - x) * 100 / x, 6) AS improvement_percent, {LEVEL.format(s='x')} AS level_before, {LEVEL.format(s='y')} AS level_after, 1 AS operation_count, n - k AS lineage_count FROM total, a, b"""))
def agg26_after_dedupe(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    kept, gone = clean.drop_duplicates(df)
    before, after = (quality.completeness(x).select("n_rows", F.col("score").alias("overall"), "level") for x in (df, kept))
    return rounded(quality.compare(before, after, 1, F.col("rows_in") - F.col("rows_out")))


@query(sql("visits", rest=dedupe() + " SELECT 'deletion' AS operation, 'duplicates' AS action, 'tablecare' AS \"user\", count(*) AS records_affected, 'duplicate_exact_matches' AS evidence_id FROM gone UNION ALL SELECT 'flagging', 'dates', 'tablecare', count(*) FILTER (WHERE visit_date < enrollment_date), NULL FROM visits"))
def aud01_audit(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    gone = clean.drop_duplicates(df)[1]
    flagged = clean.audit_row(spark, "flagging", "dates", F.count_if("date_inconsistency_flag"), source=clean.flag_dates(df))
    return clean.audit_row(spark, "deletion", "duplicates", F.count("*"), "duplicate_exact_matches", source=gone).unionByName(flagged)


@query(sql("visits", rest=dedupe() + ", " + CAP.format(t="kept") + ", corrected AS (" + CORRECTIONS.format(t="kept") + f") SELECT 'deletion' AS operation, evidence_id, CAST(count(*) * {len(V)} AS BIGINT) AS n FROM (SELECT CASE WHEN row_id IN (SELECT row_id FROM left1) THEN 'duplicate_partial_matches' ELSE 'duplicate_exact_matches' END AS evidence_id FROM gone) GROUP BY evidence_id UNION ALL SELECT 'correction', evidence_id, count(*) FROM corrected GROUP BY evidence_id"))
def aud02_lineage_union(spark, sf_dir):
    kept, gone = clean.drop_duplicates(frame(spark, sf_dir, "visits"))
    both = clean.deletion_lineage(gone).unionByName(clean.fix_outliers(kept)[1])
    return both.groupBy("operation", "evidence_id").agg(F.count("*").alias("n"))


@query(sql("visits", rest="SELECT row_id, round(coalesce(temperature, (SELECT avg(temperature) FROM visits)), 6) AS temperature FROM visits"))
def opt01_mean_impute(spark, sf_dir):
    df = frame(spark, sf_dir, "visits").select("row_id", "temperature")
    return rounded(clean.impute(df, "temperature", clean.center(df, "temperature", "mean"))[0])


@query(sql("visits", rest="SELECT row_id, coalesce(gender, (SELECT gender FROM visits WHERE gender IS NOT NULL GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1)) AS gender FROM visits"))
def opt02_mode_impute(spark, sf_dir):
    df = frame(spark, sf_dir, "visits").select("row_id", "gender")
    return clean.impute(df, "gender", clean.center(df, "gender", "mode"))[0]


@query(sql("visits", rest="SELECT row_id, age FROM visits"))
def opt03_keep_missing(spark, sf_dir):
    return frame(spark, sf_dir, "visits").select("row_id", "age")


@query(sql("visits", rest=f"q AS (SELECT {fence('lab_value', 0.01)} AS a, {fence('lab_value', 0.99)} AS b FROM visits) SELECT row_id, round(greatest(a, least(b, lab_value)), 6) AS lab_value FROM visits, q"))
def opt04_winsorize(spark, sf_dir):
    return rounded(clean.winsorize(frame(spark, sf_dir, "visits").select("row_id", "lab_value"), ["lab_value"]))


@query(sql("visits", rest="SELECT row_id, age FROM visits WHERE age IS NULL OR age BETWEEN 0 AND 120"))
def opt05_drop_outliers(spark, sf_dir):
    return clean.drop_outliers(frame(spark, sf_dir, "visits").select("row_id", "age"), {"age": (0, 120)})


@query(sql("visits", rest="SELECT row_id, age, coalesce(age NOT BETWEEN 0 AND 120, false) AS age_outlier_flag FROM visits"))
def opt06_flag_outliers(spark, sf_dir):
    return clean.treat_outliers(frame(spark, sf_dir, "visits").select("row_id", "age"), {"age": ("flag", 0, 120)})[0]


GAPS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in V)


@query(sql("visits", rest=f"p AS (SELECT row_id, row_number() OVER (PARTITION BY coalesce(patient_id, '') ORDER BY {GAPS}, row_id) AS place FROM visits) SELECT row_id FROM p WHERE place = 1"))
def opt07_keep_most_complete(spark, sf_dir):
    return clean.mark_duplicates(frame(spark, sf_dir, "visits"), ["patient_id"], "complete").where("_place = 1").select("row_id")


@query(sql("visits", rest=f"SELECT row_id, count(*) OVER (PARTITION BY {KEYS_OF}) > 1 AS duplicate_flag FROM visits"))
def opt08_flag_duplicates(spark, sf_dir):
    return clean.flag_duplicates(frame(spark, sf_dir, "visits"), ["patient_id", "visit_date"]).select("row_id", "duplicate_flag")


@query(sql("visits", rest=f"p AS (SELECT row_id, count(*) OVER (PARTITION BY {KEYS_OF}) AS n FROM visits) SELECT row_id FROM p WHERE n = 1"))
def opt09_drop_duplicate_groups(spark, sf_dir):
    return clean.drop_duplicate_groups(frame(spark, sf_dir, "visits"), ["patient_id", "visit_date"]).select("row_id")


@query(sql("visits", rest="s AS (SELECT avg(age) AS a, stddev_pop(age) AS d, min(lab_value) AS l, max(lab_value) AS h FROM visits) SELECT row_id, round((age - a) / d, 6) AS age_z, round(CASE WHEN weight > 0 THEN ln(weight) END, 6) AS weight_log, round((lab_value - l) / (h - l), 6) AS lab_value_minmax FROM visits, s"))
def opt10_normalize(spark, sf_dir):
    df = clean.normalize(clean.normalize(clean.normalize(frame(spark, sf_dir, "visits"), "age", "z"), "weight", "log"), "lab_value", "minmax")
    return rounded(df.select("row_id", "age_z", "weight_log", "lab_value_minmax"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, upper(trim(o_orderpriority)) AS code, CAST(o_custkey AS DOUBLE) AS x FROM orders")
def opt11_coerce(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    german = F.date_format("o_orderdate", "dd.MM.yyyy")
    messy = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, german).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("d"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("code"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("x"))
    return clean.coerce(messy, ["d"], ["code"], ["x"])


@query(sql("visits", rest="SELECT row_id, CASE WHEN age BETWEEN 0 AND 120 THEN age END AS age, CASE WHEN systolic_bp < 100 THEN 100 WHEN systolic_bp > 150 THEN 150 ELSE systolic_bp END AS systolic_bp, heart_rate, coalesce(heart_rate NOT BETWEEN 60 AND 100, false) AS heart_rate_outlier_flag, temperature FROM visits"))
def opt12_explicit_bounds(spark, sf_dir):
    choices = {"age": ("nullify", 0, 120), "systolic_bp": ("cap", 100.0, 150.0), "heart_rate": ("flag", 60, 100), "temperature": ("keep", 36, 37)}
    return clean.treat_outliers(frame(spark, sf_dir, "visits").select("row_id", "age", "systolic_bp", "heart_rate", "temperature"), choices)[0]


@query("SELECT c_custkey, sha256('salt' || c_name) AS hashed FROM customer")
def prv01_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", C.hash_identifier(F.col("c_name"), "salt").alias("hashed"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '********' ELSE '********' || right(c_name, 4) END AS masked, CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 2 THEN '********' ELSE '********' || right(CAST(c_custkey AS VARCHAR), 2) END AS short FROM customer")
def prv02_mask(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", C.mask(F.col("c_name")).alias("masked"), C.mask(F.col("c_custkey"), 2).alias("short"))


@query(sql("visits", rest="SELECT CAST(row_id AS VARCHAR) AS row_id, patient_id, gender, CAST(CAST(age AS BIGINT) AS VARCHAR) AS age, CAST(visit_date AS VARCHAR) AS visit_date FROM visits"))
def src01_csv_round_trip(spark, sf_dir):
    """Visits written as delimited files and loaded again, every cell text and null tokens null."""
    path = fresh_path(spark, "visits")
    df = frame(spark, sf_dir, "visits").select("row_id", "patient_id", "gender", F.col("age").cast("long").alias("age"), "visit_date")
    files.write_csv(df, path)
    return files.read_table(spark, path, separator=",", row_id=False)


@query(sql("visits", rest=dedupe() + f" SELECT field, count(*) AS n FROM (" + each(V, "SELECT '{c}' AS field FROM gone") + ") GROUP BY field"))
def snk04_lineage_export(spark, sf_dir):
    """Deleted cells by field, from the exported lineage table."""
    path = fresh_path(spark, "lineage")
    files.export(clean.deletion_lineage(clean.drop_duplicates(frame(spark, sf_dir, "visits"))[1]), path, partition_by="operation")
    return spark.read.parquet(path).groupBy("field").agg(F.count("*").alias("n"))


@query(sql("visits", rest=REPORT + f" SELECT 'visits' AS source, 'visits_clean' AS output, 'tablecare' AS \"user\", 3 AS operation_count, n_rows, {len(V)} AS n_columns, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(overall, 6) AS overall, {LEVEL.format(s='overall')} AS level FROM report"))
def snk02_metadata(spark, sf_dir):
    """The sidecar of a cleaned table, read back with the report in it."""
    path = fresh_path(spark, "metadata")
    files.write_metadata(spark, path, "visits", "visits_clean", "tablecare", quality.assess(frame(spark, sf_dir, "visits"), AS_OF), 3)
    report = F.from_json("quality_report", "n_rows long, n_columns int, completeness double, validity double, overall double, level string")
    found = spark.read.schema("quality_report string, source string, output string, user string, operation_count int").json(path)
    return rounded(found.select("source", "output", "user", "operation_count", report.alias("r")).select("source", "output", "user", "operation_count", "r.*"))


@query(sql("visits", rest=dedupe() + " SELECT 'deletion' AS operation, CAST(count(*) AS BIGINT) AS records_affected, CAST(4 AS BIGINT) AS total FROM gone UNION ALL SELECT 'flagging', count(*) FILTER (WHERE visit_date < enrollment_date), 4 FROM visits"))
def snk03_audit_export(spark, sf_dir):
    """Audit rows exported twice and read back: each operation with the total count that the second export reports."""
    df, path = frame(spark, sf_dir, "visits"), fresh_path(spark, "audit")
    audit = clean.audit_row(spark, "deletion", "duplicates", F.count("*"), "duplicate_exact_matches", source=clean.drop_duplicates(df)[1])
    audit = audit.unionByName(clean.audit_row(spark, "flagging", "dates", F.count_if("date_inconsistency_flag"), source=clean.flag_dates(df)))
    files.export(audit, path, "json")
    total = files.export(audit, path, "json")
    return spark.read.schema(audit.schema).json(path).groupBy("operation").agg(F.max("records_affected").alias("records_affected")).withColumn("total", F.lit(total).cast("long"))


@query(sql("visits", rest=REPORT + f" SELECT n_rows, {len(V)} AS n_columns, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(consistency, 6) AS consistency, round(uniqueness, 6) AS uniqueness, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall FROM report"))
def snk05_report_export(spark, sf_dir):
    """The quality report, written as JSON and read back."""
    path = fresh_path(spark, "report")
    report = quality.assess(frame(spark, sf_dir, "visits"), AS_OF, "visits")
    files.write_report(report, path)
    return rounded(spark.read.schema(report.schema).json(path).drop("dataset_name", "level"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'supplier' FROM supplier")
def src04_many_paths(spark, sf_dir):
    """A dataset of two paths: all of its files are read as one table."""
    paths = []
    for kind, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        df = spark.read.parquet(f"{sf_dir}/{kind}.parquet")
        paths.append(fresh_path(spark, kind))
        files.write_csv(df.select(F.col(key).alias("key"), F.col(f"{key[0]}_name").alias("name"), F.lit(kind).alias("kind")), paths[-1])
    wanted = files.dataset("partners", "clinical_trial", paths)
    return files.read_table(spark, wanted["raw_paths"], separator=",", row_id=False)


PARTNERS = """WITH partners AS (
  SELECT 0 AS place, n_nationkey AS number, n_name AS name, n_nationkey AS nation FROM nation
  UNION ALL SELECT 1, c_custkey, c_name, c_nationkey FROM customer
  UNION ALL SELECT 2, s_suppkey, s_name, s_nationkey FROM supplier),
numbered AS (SELECT row_number() OVER (ORDER BY place, number) - 1 AS row_id, CAST(number AS VARCHAR) AS number, name, CAST(nation AS VARCHAR) AS nation FROM partners)
"""


def _partners(spark, sf_dir):
    """Nations, customers and suppliers in files of very unequal size, read as one table in this order."""
    paths = []
    for kind, key in (("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        df = spark.read.parquet(f"{sf_dir}/{kind}.parquet")
        paths.append(fresh_path(spark, kind))
        files.write_csv(df.select(F.col(key).alias("number"), F.col(f"{key[0]}_name").alias("name"), F.col(f"{key[0]}_nationkey").alias("nation")).orderBy("number"), paths[-1])
    return files.read_table(spark, paths, separator=",").withColumnRenamed(files.ROW_ID, "row_id").select("row_id", "number", "name", "nation")


@query(PARTNERS + "SELECT * FROM numbered")
def src04_row_order(spark, sf_dir):
    """Rows of several paths are numbered from 0 in the order of the paths."""
    return _partners(spark, sf_dir)


@query(PARTNERS + "SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY nation ORDER BY row_id) = 1")
def src04_keep_first(spark, sf_dir):
    """Of rows of one nation the first in the order of the paths stays."""
    return clean.drop_duplicates(_partners(spark, sf_dir), ["nation"])[0]


@query(PARTNERS + "SELECT row_id, number, name, nation FROM numbered WHERE row_id < 30")
def src07_head_of_files(spark, sf_dir):
    """The first thirty rows: all nations, then the first customers."""
    return files.head(_partners(spark, sf_dir), 30, order_by="row_id")


@query(" UNION ALL ".join(f"SELECT '{kind}' AS format, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, count(o.o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY ALL" for kind in ("csv", "json", "parquet", "tsv")))
def src05_formats(spark, sf_dir):
    """Orders by nation, written in each format that is read by its ending, and loaded again."""
    nation, customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "orders"))
    df = nation.join(customer, nation["n_nationkey"] == customer["c_nationkey"], "left").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("o_orderkey").alias("orders"))
    found = []
    for kind in ("csv", "json", "parquet", "tsv"):
        path = f"{fresh_path(spark, 'nations')}.{kind}"
        writer = df.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        getattr(writer, "csv" if kind in ("csv", "tsv") else kind)(path)
        found.append(files.read_table(spark, path, row_id=False).select(F.lit(kind).alias("format"), F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("orders").cast("long").alias("orders")))
    return reduce(DataFrame.unionByName, found)


@query(sql("visits", rest="SELECT CAST(count(*) AS BIGINT) AS n_rows, count(age) AS ages, min(age) AS least, max(age) AS most, count(heart_rate) AS heart_rates, true AS unchanged FROM visits"))
def src08_original_kept(spark, sf_dir):
    """The stored source after a whole clean of it, and whether its rows have the hashes that they had before."""
    path = fresh_path(spark, "source")
    frame(spark, sf_dir, "visits").write.parquet(path)
    prints = lambda: spark.read.parquet(path).select(F.xxhash64("*").cast("decimal(20,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
    before = prints()
    pipeline.run(spark.read.parquet(path), AS_OF)
    same = F.lit(prints() == before)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.count("age").alias("ages"), F.min("age").alias("least"), F.max("age").alias("most"), F.count("heart_rate").alias("heart_rates"), same.alias("unchanged"))


@query(sql("visits", rest=f"SELECT row_id, {COLUMNS} FROM visits"))
def cln03_restore(spark, sf_dir):
    """Visits cleaned as a whole and taken back by their lineage: the source, cell by cell."""
    done = pipeline.run(frame(spark, sf_dir, "visits"), AS_OF)
    return plain(lineage.restore(done.table, done.lineage, V))


@query(sql("visits", rest=whole_clean() + f" SELECT row_id, {COLUMNS.replace('lab_value', 'round(lab_value, 6) AS lab_value')} FROM done"))
def cln03_replay(spark, sf_dir):
    """The changes of a whole clean made again on the source: the cleaned table without its flags."""
    df = frame(spark, sf_dir, "visits")
    return rounded(plain(lineage.replay(df, pipeline.run(df, AS_OF).lineage, V)))


@query(sql("visits", rest=whole_clean() + f", ways AS ({WAYS}), corrected AS (" + CORRECTIONS.format(t="kept") + f""") SELECT CAST((SELECT count(*) FROM done) AS BIGINT) AS table_rows, CAST({LINEAGE_SIZE} AS BIGINT) AS lineage_rows, CAST(3 + (SELECT count(*) FROM ways WHERE gaps > 0) AS BIGINT) AS audit_rows,
(SELECT count(*) FROM done) AS read_rows, (SELECT round(sum(weight), 6) FROM done) AS weight, (SELECT count(*) FROM visits) AS rows_in"""))
def snk01_published_run(spark, sf_dir):
    """A clean published as one act: the counts in its manifest, and what a reader finds by it."""
    path = fresh_path(spark, "published")
    publish.clean(frame(spark, sf_dir, "visits"), path, "run1", AS_OF, "visits")
    found = publish.read(spark, path)
    rows = {f"{name}_rows": F.lit(f["rows"]).cast("long") for name, f in found.manifest["files"].items() if name != "report"}
    one = found.tables["table"].agg(F.count("*").alias("read_rows"), F.sum("weight").alias("weight"))
    return rounded(one.withColumns(rows | {"rows_in": F.lit(found.manifest["report"]["rows_in"]).cast("long")}))
