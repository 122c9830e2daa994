"""Queries of validation, rules, plans and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.storage import fresh_path
from ..operators import issues, rules, validate
from ..streaming import events, store
from . import planning
from .fixtures import frame, sql
from .queries_quality import ISSUES
from .registry import query, rounded

FIELDS = ["systolic_bp", "heart_rate", "temperature"]
VITAL_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS field, {c} AS value, row_id % 5 = 0 AS athlete FROM visits WHERE {c} IS NOT NULL" for c in [*FIELDS, "weight"]) + "), ranges AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for f, a, b in R.PLAUSIBLE) + ") t(field, low, high)), known AS (SELECT c.*, low, high FROM cells c LEFT JOIN ranges USING (field))"
VITALS = VITAL_CELLS + """, vitals AS (
SELECT row_id, field, 'unknown_field' AS rule, 'warning' AS severity, low, high, value FROM known WHERE low IS NULL
UNION ALL SELECT row_id, field, 'out_of_range', 'error', low, high, value FROM known WHERE value < low OR value > high
UNION ALL SELECT row_id, field, 'bradycardia', 'warning', low, high, value FROM known WHERE field = 'heart_rate' AND value BETWEEN low AND high AND value < 50 AND NOT athlete
UNION ALL SELECT row_id, field, 'tachycardia', 'warning', low, high, value FROM known WHERE field = 'heart_rate' AND value BETWEEN low AND high AND value > 100
UNION ALL SELECT row_id, field, 'high_pressure', 'note', low, high, value FROM known WHERE field IN ('systolic_bp', 'diastolic_bp') AND value > high
UNION ALL SELECT row_id, field, 'low_pressure', 'note', low, high, value FROM known WHERE field IN ('systolic_bp', 'diastolic_bp') AND value < low
UNION ALL SELECT row_id, field, 'fever', 'warning', low, high, value FROM known WHERE field = 'temperature' AND value > 38
UNION ALL SELECT row_id, field, 'hypothermia', 'note', low, high, value FROM known WHERE field = 'temperature' AND value < low)"""


def _vitals(spark, sf_dir):
    df = frame(spark, sf_dir, "visits").withColumn("athlete", F.col("row_id") % 5 == 0)
    return validate.vital_signs(validate.cells(df, [*FIELDS, "weight"], more=["athlete"]), F.col("athlete"))


def _vital_query(code: str, chosen: tuple[str, ...]):
    listed = ", ".join(f"'{r}'" for r in chosen)

    def run(spark, sf_dir):
        return _vitals(spark, sf_dir).where(F.col("rule").isin(*chosen))

    run.__name__ = code
    query(sql("visits", rest=VITALS + f" SELECT * FROM vitals WHERE rule IN ({listed})"))(run)


_vital_query("val01_vital_ranges", ("out_of_range", "unknown_field"))
_vital_query("val02_heart_rate", ("bradycardia", "tachycardia"))
_vital_query("val03_range_notes", ("high_pressure", "low_pressure", "fever", "hypothermia"))


@query(sql("visits", rest="SELECT row_id, 'age' AS field, CASE WHEN age < 0 OR age > 120 THEN 'age_impossible' ELSE 'age_unlikely' END AS rule, CASE WHEN age < 0 OR age > 120 THEN 'error' ELSE 'warning' END AS severity, CAST(CAST(age AS BIGINT) AS VARCHAR) AS value FROM visits WHERE age < 0 OR age > 110"))
def val04_age(spark, sf_dir):
    return validate.age(frame(spark, sf_dir, "visits").withColumn("age", F.col("age").cast("long")))


DATE_TEXT = "d AS (SELECT row_id, CAST(enrollment_date AS VARCHAR) AS a, CASE WHEN row_id % 7 = 0 THEN 'soon' ELSE CAST(visit_date AS VARCHAR) END AS b FROM visits)"


@query(sql("visits", rest=DATE_TEXT + " SELECT row_id, 'b' AS field, 'later_unreadable' AS rule, 'error' AS severity, b AS value FROM d WHERE b = 'soon' UNION ALL SELECT row_id, 'b', 'wrong_order', 'error', b FROM d WHERE b <> 'soon' AND CAST(b AS DATE) < CAST(a AS DATE)".replace("CAST(b AS DATE)", "TRY_CAST(b AS DATE)")))
def val05_date_order(spark, sf_dir):
    df = frame(spark, sf_dir, "visits")
    texts = df.select("row_id", F.col("enrollment_date").cast("string").alias("a"), F.when(F.col("row_id") % 7 == 0, "soon").otherwise(F.col("visit_date").cast("string")).alias("b"))
    return validate.date_order(texts, "a", "b")


BMI_SQL = "CASE WHEN weight <= 0 OR weight > 300 THEN 'weight_impossible' WHEN height <= 0 OR height > 250 THEN 'height_impossible' " + " ".join(f"WHEN weight / power(height / 100, 2) < {x} THEN '{n}'" for x, n in R.BMI_CLASSES) + " ELSE 'severely_high' END"


@query(sql("visits", rest=f"b AS (SELECT row_id, weight / power(height / 100, 2) AS bmi, {BMI_SQL} AS bmi_class FROM visits) SELECT row_id, round(CASE WHEN bmi_class NOT LIKE '%impossible' THEN bmi END, 6) AS bmi, bmi_class, CASE WHEN bmi_class LIKE '%impossible' OR bmi_class LIKE 'severely%' THEN 'error' WHEN bmi_class = 'normal' THEN 'ok' ELSE 'warning' END AS severity FROM b"))
def val06_bmi(spark, sf_dir):
    return rounded(validate.bmi(frame(spark, sf_dir, "visits")))


LAB_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{c}', '{u}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (t, c, u, a, b) in enumerate(R.LAB)) + """) t(place, test, context, range_unit, low, high)),
j AS (SELECT l.row_id, l.test, l.value, l.unit, r.*EXCLUDE(test), row_number() OVER (PARTITION BY l.row_id, l.test ORDER BY CASE WHEN coalesce(r.context = CASE WHEN l.fasting THEN 'fasting' WHEN NOT l.fasting THEN 'random' END OR r.context = lower(l.sex), false) THEN 0 ELSE 1 END, r.place) AS k FROM labs l JOIN r USING (test)),
b AS (SELECT * FROM j WHERE k = 1)
SELECT row_id, test, context, 'unit_mismatch' AS rule, 'warning' AS severity, low, high, value FROM b WHERE lower(unit) <> lower(range_unit)
UNION ALL SELECT row_id, test, context, 'out_of_range', 'error', low, high, value FROM b WHERE value < low OR value > high
UNION ALL SELECT row_id, test, context, CASE WHEN (test = 'glucose' AND value >= 126) OR (test = 'hba1c' AND value >= 6.5) THEN 'diabetes' ELSE 'prediabetes' END, 'note', low, high, value FROM b WHERE (test = 'glucose' AND value >= 100) OR (test = 'hba1c' AND value >= 5.7)"""


@query(sql("labs", rest=LAB_SQL))
def val07_lab_values(spark, sf_dir):
    return validate.lab_values(frame(spark, sf_dir, "labs"))


@query(sql("labs", rest=r"SELECT row_id, 'icd10' AS field, 'icd10_format' AS rule, 'error' AS severity, icd10 AS value FROM labs WHERE NOT coalesce(regexp_matches(trim(upper(icd10)), '^[A-Z][0-9]{2}(\.[0-9]{1,2})?$'), false)"))
def val08_icd10(spark, sf_dir):
    return validate.icd10(frame(spark, sf_dir, "labs"))


@query(sql("visits", rest="SELECT row_id, concat_ws(',', CASE WHEN patient_id IS NULL THEN 'patient_id' END, CASE WHEN age IS NULL THEN 'age' END, CASE WHEN gender IS NULL THEN 'gender' END) AS missing_fields FROM visits WHERE patient_id IS NULL OR age IS NULL OR gender IS NULL"))
def val09_required(spark, sf_dir):
    return validate.required(frame(spark, sf_dir, "visits"), ["patient_id", "age", "gender"]).withColumn("missing_fields", F.concat_ws(",", "missing_fields"))


@query(sql("visits", rest=VITALS + " SELECT row_id, count(*) FILTER (WHERE severity = 'error') = 0 AS valid, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, " + ", ".join(f"coalesce(string_agg(field || ':' || rule, ',' ORDER BY field || ':' || rule) FILTER (WHERE severity = '{s}'), '') AS {s}s" for s in ("error", "warning", "note")) + " FROM vitals GROUP BY row_id"))
def val10_results(spark, sf_dir):
    return validate.results(_vitals(spark, sf_dir))


def _rule_values() -> str:
    def text(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "CAST([" + ", ".join(text(y) for y in x) + "] AS VARCHAR[])"
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join([str(i), *map(text, r)]) + ")" for i, r in enumerate(rules.RULES))
    return f"rules AS (SELECT * FROM (VALUES {rows}) t(ordinal, id, source, category, topic, evidence_level, confidence, conditions, contraindications, tags, field, low, high, statement))"


RULES = _rule_values()
CONF = "CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
EVID = "CASE evidence_level " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(rules.EVIDENCE)) + " END"
#: What is known about each patient row that rules are asked for.
FACTS = "asked AS (SELECT row_id AS finding_id, CASE row_id % 4 WHEN 0 THEN 'missing_data' WHEN 1 THEN 'outliers' WHEN 2 THEN 'transformation' ELSE 'duplicates' END AS category, CASE row_id % 3 WHEN 0 THEN 'blood_pressure' WHEN 1 THEN 'vital_signs' ELSE 'bmi' END AS of_field, age, CAST(row_id % 10 AS DOUBLE) / 100 AS missing_rate, row_id % 8 < 4 AS mcar, row_id % 5 = 0 AS skewed, age > 40 AS athlete, row_id % 6 < 3 AS zero FROM patients)"


def _asked(spark, sf_dir):
    row = F.col("row_id")
    flag = lambda c: c.cast("double")
    facts = {"missing_rate": (row % 10).cast("double") / 100, "mcar_assumption": flag(row % 8 < 4), "positive_values": F.lit(1.0), "right_skewed": flag(row % 5 == 0), "zero_values": flag(row % 6 < 3), "age": F.col("age"), "at_rest": F.lit(1.0), "athlete": flag(F.col("age") > 40)}
    category = F.when(row % 4 == 0, "missing_data").when(row % 4 == 1, "outliers").when(row % 4 == 2, "transformation").otherwise("duplicates")
    of_field = F.when(row % 3 == 0, "blood_pressure").when(row % 3 == 1, "vital_signs").otherwise("bmi")
    return frame(spark, sf_dir, "patients").select(row.alias("finding_id"), category.alias("category"), of_field.alias("of_field"), "age", F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]).alias("facts"))


@query(f"WITH {RULES}, cats AS (SELECT p_size, p_partkey FROM part) SELECT p_partkey, id FROM cats JOIN rules ON category = CASE p_size % 2 WHEN 0 THEN 'vital_signs' ELSE 'missing_data' END AND confidence IN ('high') AND list_has_any(tags, ['vital_signs', 'imputation']) AND contains(lower(topic), 'i')")
def kb01_search(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "vital_signs").otherwise("missing_data").alias("category"))
    found = rules.search(rules.rules(spark), topic="I", tags=["vital_signs", "imputation"], min_confidence="high")
    return parts.join(F.broadcast(found), "category").select("p_partkey", "id")


@query(sql("patients", rest=FACTS + f", {RULES}, b AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY {CONF}, ordinal) AS k FROM rules WHERE confidence IN ('high', 'medium')) SELECT finding_id, id FROM asked JOIN b USING (category) WHERE k = 1"))
def kb02_best(spark, sf_dir):
    table = rules.rules(spark)
    best = None
    for category in ("missing_data", "outliers", "transformation", "duplicates"):
        one = rules.best(rules.search(table, category=category)).select("category", "id")
        best = one if best is None else best.union(one)
    return _asked(spark, sf_dir).join(F.broadcast(best), "category").select("finding_id", "id")


@query(sql("patients", rest=FACTS + f", {RULES} SELECT finding_id, id AS rule_id, 'athlete' AS contraindication FROM asked JOIN rules ON list_contains(tags, of_field) WHERE id = 'anthro_bmi_categories' AND age >= 18 AND athlete"))
def kb03_contraindications(spark, sf_dir):
    return rules.contraindicated(_asked(spark, sf_dir), rules.rules(spark))


@query(sql("patients", rest="asked AS (SELECT row_id AS finding_id, CASE row_id % 3 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'vital_signs' ELSE 'age_specific' END AS of_field, CASE WHEN row_id % 5 = 0 THEN NULL ELSE age - 10 END AS age FROM patients), " + RULES + f", j AS (SELECT finding_id, of_field, age, id AS rule_id, low, high, row_number() OVER (PARTITION BY finding_id ORDER BY CASE WHEN coalesce(age < 18 AND list_contains(conditions, 'age >= 18'), false) THEN 1 ELSE 0 END, CASE WHEN coalesce(age >= 65 AND list_contains(tags, 'geriatric'), false) THEN 0 ELSE 1 END, {CONF}, ordinal) AS k FROM asked JOIN rules ON list_contains(tags, of_field)) SELECT finding_id, of_field, age, rule_id, low, high FROM j WHERE k = 1"))
def kb04_reference_ranges(spark, sf_dir):
    row = F.col("row_id")
    wanted = frame(spark, sf_dir, "patients").select(row.alias("finding_id"), F.when(row % 3 == 0, "heart_rate").when(row % 3 == 1, "vital_signs").otherwise("age_specific").alias("of_field"), F.when(row % 5 != 0, F.col("age") - 10).alias("age"))
    return rules.reference_ranges(wanted, rules.rules(spark))


HOLDS = "CASE id WHEN 'missing_complete_case_analysis' THEN missing_rate < 0.05 AND mcar WHEN 'missing_median_imputation_robust' THEN false WHEN 'missing_multiple_imputation' THEN false WHEN 'outlier_iqr_method' THEN false WHEN 'duplicate_partial_matches' THEN false WHEN 'transform_log_skewed' THEN skewed AND NOT zero ELSE true END"


@query(sql("patients", rest=FACTS + f", {RULES}, j AS (SELECT finding_id, category, id AS rule_id, confidence, evidence_level, {HOLDS} AS applicable, ordinal FROM asked JOIN rules USING (category) WHERE confidence IN ('high', 'medium')), o AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY CASE WHEN applicable THEN 0 ELSE 1 END, {CONF}, {EVID}, ordinal) AS k FROM j) SELECT finding_id, category, rule_id, confidence, evidence_level, applicable FROM o WHERE k = 1"))
def kb05_recommend(spark, sf_dir):
    return rules.recommend(_asked(spark, sf_dir), rules.rules(spark))


@query(sql("patients", rest=FACTS + f", {RULES}, j AS (SELECT finding_id, category, id AS rule_id, confidence, evidence_level, {HOLDS} AS applicable, ordinal FROM asked JOIN rules USING (category) WHERE confidence IN ('high', 'medium')), o AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY CASE WHEN applicable THEN 0 ELSE 1 END, {CONF}, {EVID}, ordinal) AS k FROM j) SELECT finding_id, id, statement || CASE WHEN len(conditions) > 0 THEN ' When: ' || array_to_string(conditions, ', ') || '.' ELSE '' END || CASE WHEN len(contraindications) > 0 THEN ' Not with: ' || array_to_string(contraindications, ', ') || '.' ELSE '' END || ' Basis: ' || r.evidence_level || ', confidence ' || r.confidence || '.' AS explanation FROM o JOIN rules r ON r.id = o.rule_id WHERE k = 1"))
def kb06_explain(spark, sf_dir):
    """The rule recommended for each finding, explained."""
    table = rules.rules(spark)
    chosen = rules.recommend(_asked(spark, sf_dir), table).select("finding_id", F.col("rule_id").alias("id"))
    return chosen.join(F.broadcast(rules.explain(table)), "id").select("finding_id", "id", "explanation")  # a row for each rule


@query(sql("visits", rest=ISSUES + f", {RULES} SELECT i.field, i.code, r.id, r.topic, r.confidence FROM issues i JOIN rules r ON r.id = i.evidence_id"))
def kb07_by_id(spark, sf_dir):
    found = issues.detect(frame(spark, sf_dir, "visits")).select("field", "code", F.col("evidence_id").alias("id"))
    return found.join(F.broadcast(rules.rules(spark).select("id", "topic", "confidence")), "id").select("field", "code", "id", "topic", "confidence")


@query(f"WITH {RULES} SELECT e.event_type, r.id FROM (SELECT DISTINCT event_type FROM events) e JOIN rules r ON r.source = CASE WHEN e.event_type IN ('error', 'view') THEN 'evidence' ELSE 'standard' END WHERE list_has_any(r.tags, ['missing_data', 'vital_signs'])")
def kb08_listing(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().withColumn("source", F.when(F.col("event_type").isin("error", "view"), "evidence").otherwise("standard"))
    return kinds.join(F.broadcast(rules.search(rules.rules(spark), tags=["missing_data", "vital_signs"])), "source").select("event_type", "id")


@query(sql("visits", rest=ISSUES + f", {RULES}, f AS (SELECT DISTINCT category FROM rules WHERE contains(lower(concat_ws(' ', id, topic, statement, array_to_string(tags, ' '))), 'imputation')) SELECT i.field, f.category FROM issues i JOIN f USING (category)"))
def kb09_free_text(spark, sf_dir):
    facets = rules.free_text(rules.rules(spark), "Imputation").select("category").distinct()
    return issues.detect(frame(spark, sf_dir, "visits")).join(F.broadcast(facets), "category").select("field", "category")


ADVISED = "f AS (SELECT CASE category WHEN 'missing_data' THEN 'missing_data' WHEN 'duplicates' THEN 'duplicates' WHEN 'vital_signs' THEN 'outliers' WHEN 'demographics' THEN 'outliers' END AS advice, coalesce(mcar, false) AS mcar, ordinal FROM issues), o AS (SELECT advice, arg_min(mcar, ordinal) AS mcar FROM f WHERE advice IS NOT NULL GROUP BY advice)"


@query(sql("visits", rest=ISSUES + f", {ADVISED}, {RULES}, j AS (SELECT advice, id, confidence, CASE id WHEN 'missing_complete_case_analysis' THEN false WHEN 'missing_median_imputation_robust' THEN false WHEN 'missing_multiple_imputation' THEN false WHEN 'outlier_iqr_method' THEN false WHEN 'duplicate_partial_matches' THEN false ELSE true END AS fits, row_number() OVER (PARTITION BY advice ORDER BY CASE WHEN id IN ('missing_complete_case_analysis', 'missing_median_imputation_robust', 'missing_multiple_imputation', 'outlier_iqr_method', 'duplicate_partial_matches') THEN 1 ELSE 0 END, {CONF}, {EVID}, ordinal) AS k FROM o JOIN rules ON category = advice WHERE confidence IN ('high', 'medium')) SELECT advice AS finding_id, id AS rule_id FROM j WHERE k = 1"))
def iss09_recommendations(spark, sf_dir):
    found = issues.findings(issues.detect(frame(spark, sf_dir, "visits")))
    return rules.recommend(found, rules.rules(spark)).select("finding_id", "rule_id")


PSTEPS = """psteps AS (
SELECT dataset_id, 'missing' AS kind, 'handle missing values: ' || "column" AS name, 'cleaning' AS step_type, CASE WHEN missing_rate > 0.1 THEN 'high' ELSE 'medium' END AS priority, false AS required, CASE WHEN missing_rate > 0.2 THEN 'medium' ELSE 'low' END AS risk, "column" AS field, ordinal * 2 + 100 AS place FROM profiles WHERE missing_rate > 0
UNION ALL SELECT dataset_id, 'outliers', 'handle outliers: ' || "column", 'cleaning', 'medium', false, 'medium', "column", ordinal * 2 + 101 FROM profiles WHERE outlier_count > 0
UNION ALL SELECT dataset_id, 'duplicates', 'remove duplicates', 'cleaning', 'high', true, 'medium', NULL, 100000 FROM profiles WHERE duplicate_count > 0 AND is_key_column GROUP BY dataset_id)"""
WORDS = "words AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in planning.KEYWORDS) + ") t(word, kind)), osteps0 AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{t}', '{p}', {str(r).lower()}, '{risk}', {i})" for k, n, t, p, r, risk, i in planning.OBJECTIVE_STEPS) + ") t(kind, name, step_type, priority, required, risk, place)), asked AS (SELECT DISTINCT dataset_id, kind FROM objectives JOIN words ON contains(lower(objective), word)), osteps AS (SELECT a.dataset_id, kind, name, step_type, priority, required, risk, CAST(NULL AS VARCHAR) AS field, place + 200000 AS place FROM asked a JOIN osteps0 USING (kind) WHERE NOT (kind IN ('duplicates', 'missing') AND EXISTS (SELECT 1 FROM psteps p WHERE p.dataset_id = a.dataset_id AND p.kind = a.kind)))"


def _fixed(steps, base: int) -> str:
    return " UNION ALL ".join(f"SELECT dataset_id, '{k}', '{n}', '{t}', '{p}', {str(r).lower()}, '{risk}', CAST(NULL AS VARCHAR), {base + i} FROM (SELECT DISTINCT dataset_id FROM profiles)" for k, n, t, p, r, risk, i in steps)


PLAN = PSTEPS + ", " + WORDS + ", every AS (SELECT * FROM psteps UNION ALL SELECT * FROM osteps UNION ALL " + _fixed(planning.FIRST_STEPS, 0) + " UNION ALL " + _fixed(planning.LAST_STEPS, 300000) + """),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY CASE step_type WHEN 'validation' THEN 1 WHEN 'cleaning' THEN 2 WHEN 'transformation' THEN 3 ELSE 4 END, CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, place, kind) AS step FROM every),
named AS (SELECT *, 'step-' || lpad(CAST(step AS VARCHAR), 3, '0') AS step_id FROM numbered),
checks AS (SELECT dataset_id, string_agg(step_id, ',' ORDER BY step_id) AS ids FROM named WHERE step_type = 'validation' GROUP BY dataset_id),
plan AS (SELECT dataset_id, step_id, kind, name, step_type, priority, required, risk, field, CASE WHEN step_type = 'validation' THEN '' ELSE ids END AS depends_on FROM named JOIN checks USING (dataset_id))"""
STEP_COLUMNS = "dataset_id, step_id, kind, name, step_type, priority, required, risk, field, depends_on"


def _plan(spark, sf_dir):
    return planning.plan(frame(spark, sf_dir, "profiles"), frame(spark, sf_dir, "objectives"))


def _plan_query(code: str, where: str):
    def run(spark, sf_dir):
        return _plan(spark, sf_dir).where(where)

    run.__name__ = code
    query(sql("profiles", "objectives", rest=PLAN + f" SELECT {STEP_COLUMNS} FROM plan WHERE {where}"))(run)


_plan_query("pln01_first_steps", "kind IN ('profile', 'schema')")
_plan_query("pln04_last_steps", "step_type = 'verification'")
_plan_query("pln05_ordered_plan", "step_id IS NOT NULL")


@query(sql("profiles", "objectives", rest=PSTEPS + " SELECT dataset_id, kind, name, step_type, priority, required, risk, field, CAST(place AS BIGINT) AS place FROM psteps"))
def pln02_profile_steps(spark, sf_dir):
    return planning.profile_steps(frame(spark, sf_dir, "profiles"))


@query(sql("profiles", "objectives", rest=PSTEPS + ", " + WORDS + " SELECT dataset_id, kind, name, step_type, priority, required, risk, field, CAST(place AS BIGINT) AS place FROM osteps"))
def pln03_objective_steps(spark, sf_dir):
    return planning.objective_steps(frame(spark, sf_dir, "objectives"), planning.profile_steps(frame(spark, sf_dir, "profiles")))


@query(sql("profiles", "objectives", rest=PLAN + ", e AS (SELECT dataset_id, count(*) AS steps, count(*) FILTER (WHERE step_type = 'cleaning') AS c, count(*) FILTER (WHERE risk <> 'low') AS r FROM plan GROUP BY dataset_id) SELECT dataset_id, steps, round(least(0.05 + 0.07 * CAST(c AS DOUBLE), 0.5), 2) AS improvement, round(least(0.02 * CAST(r AS DOUBLE), 0.15), 3) AS data_loss, least(0.02 * CAST(r AS DOUBLE), 0.15) > 0.05 AS loss_warning FROM e"))
def pln06_estimates(spark, sf_dir):
    return planning.estimate(_plan(spark, sf_dir))


@query(sql("visits", rest=ISSUES + "SELECT 'visits' AS dataset_id, concat_ws(' ', category, code, 'in', field) AS objective FROM issues WHERE severity IN ('critical', 'high')"))
def pln07_objectives_from_issues(spark, sf_dir):
    return planning.objectives_of(issues.detect(frame(spark, sf_dir, "visits")).withColumn("dataset_id", F.lit("visits")))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")


E = "event_id, ts, user_id, event_type"


@query(f"WITH last AS (SELECT {E} FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT {E} FROM last ORDER BY ts, event_id")
def str01_history(spark, sf_dir):
    return events.history(_events(spark, sf_dir), types=["error", "purchase"])


@query(f"SELECT {E} FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def str02_retention(spark, sf_dir):
    return events.retain(_events(spark, sf_dir))


@query(f"WITH p AS (SELECT {E}, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT {E} FROM p WHERE k <= 3")
def str02_retention_each(spark, sf_dir):
    return events.retain_each(_events(spark, sf_dir), 3)


@query(f"SELECT {E} FROM events WHERE event_type IN ('error', 'signup')")
def str03_subscription(spark, sf_dir):
    """The events that a subscription to two types is sent, as its stream writes them when all files are read."""
    return _streamed(spark, sf_dir, ["error", "signup"])


@query(f"SELECT {E} FROM events")
def str04_replay(spark, sf_dir):
    """All events, as a stream that starts with the earliest writes them."""
    return _streamed(spark, sf_dir, None)


def _streamed(spark, sf_dir, types):
    schema = _events(spark, sf_dir).schema
    base = fresh_path(spark, "stream")
    stream = events.follow(spark, f"{sf_dir}/events.parquet*", schema, types=types)
    events.append_to(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _arriving(spark, sf_dir):
    """A folder of event files that overlap in part, and the schema of the events."""
    folder, own = fresh_path(spark, "arriving"), _events(spark, sf_dir)
    for part in ("event_id % 3 < 2", "event_id % 3 > 0"):
        own.where(part).write.mode("append").parquet(folder)
    return folder, own.schema


def _stored_history(spark, sf_dir):
    """Every event once in a stored history, from files that repeat a third of them."""
    folder, schema = _arriving(spark, sf_dir)
    base = fresh_path(spark, "history")
    stream = store.once(events.follow(spark, folder, schema), "3650 days")
    store.run(stream, store.history_sink(f"{base}/events"), f"{base}/state").awaitTermination()
    return f"{base}/events", schema


@query(f"SELECT {E} FROM events")
def str04_replay_once(spark, sf_dir):
    """All events once, as a stream over files that overlap stores them."""
    return store.history(spark, *_stored_history(spark, sf_dir))


@query(f"WITH p AS (SELECT {E}, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT {E} FROM p WHERE k <= 3")
def str02_retained_by_stream(spark, sf_dir):
    """The newest three events of each job, held as the state of a stream."""
    schema, base = _events(spark, sf_dir).schema, fresh_path(spark, "retained")
    stream = events.follow(spark, f"{sf_dir}/events.parquet*", schema)
    store.retain(stream, 3, f"{base}/kept", f"{base}/state").awaitTermination()
    return store.kept(spark, f"{base}/kept", schema)


@query(f"SELECT {E} FROM events WHERE user_id IS DISTINCT FROM 1")
def str05_purge(spark, sf_dir):
    return events.purge(_events(spark, sf_dir), 1)


@query("SELECT event_id, ts, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, event_type FROM events WHERE event_id % 7 = 0 OR user_id IS DISTINCT FROM 1")
def str05_purge_without_jobs(spark, sf_dir):
    """Events of no job stay when a job's history is cleared."""
    some = _events(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    return events.purge(some, 1)


@query(f"SELECT {E} FROM events WHERE user_id IS DISTINCT FROM 1")
def str05_purged_history(spark, sf_dir):
    """A stored history after a job's events are deleted from it."""
    path, schema = _stored_history(spark, sf_dir)
    store.purge(spark, path, schema, 1)
    return store.history(spark, path, schema)


JOBS = "jobs AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_steps, count(*) FILTER (WHERE event_type = 'error') AS n_pending FROM events GROUP BY user_id)"


@query(f"WITH {JOBS} SELECT * FROM jobs")
def str06_jobs(spark, sf_dir):
    return events.jobs(_events(spark, sf_dir))


@query(f"WITH {JOBS} SELECT * FROM jobs")
def str06_listing_by_stream(spark, sf_dir):
    """The job listing that a stream keeps up to date in a stored table."""
    own, base = _events(spark, sf_dir), fresh_path(spark, "listing")
    store.follow_jobs(events.follow(spark, f"{sf_dir}/events.parquet*", own.schema), f"{base}/jobs", f"{base}/state").awaitTermination()
    return store.listing(spark, f"{base}/jobs", events.jobs(own).schema)


@query(f"WITH {JOBS} SELECT * FROM jobs ORDER BY last_ts DESC, user_id LIMIT 100")
def str06_newest_jobs(spark, sf_dir):
    return events.newest_first(events.jobs(_events(spark, sf_dir)))


@query(f"WITH {JOBS} SELECT status, count(*) AS n_jobs FROM jobs GROUP BY status")
def str07_status_counts(spark, sf_dir):
    return events.status_counts(events.jobs(_events(spark, sf_dir)))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str07_daily_counts(spark, sf_dir):
    return events.windowed_counts(_events(spark, sf_dir))
