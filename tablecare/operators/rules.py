"""Evidence rules as a small table: search, recommendation, ranges, contraindications and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks, best first.
CONFIDENCE = ("high", "medium", "low")
EVIDENCE = ("systematic_review", "randomized_trial", "cohort_study", "case_control", "best_practice", "expert_opinion")

SCHEMA = "ordinal int, id string, source string, category string, topic string, evidence_level string, confidence string, conditions array<string>, contraindications array<string>, tags array<string>, field string, low double, high double, statement string"

# Identifiers, categories, topics, levels, conditions and tags. Statements are our own.
# id; source; category; topic; evidence; confidence; conditions; contraindications; tags; field; low; high; statement
RULES = [
    ("vs_blood_pressure_normal", "standard", "vital_signs", "blood_pressure_normal_range", "systematic_review", "high", ["age >= 18", "at_rest"], [], ["blood_pressure", "systolic_bp", "diastolic_bp", "vital_signs"], "systolic_bp", 90.0, 120.0, "Resting adults: 90-120 over 60-80 mmHg."),
    ("vs_heart_rate_normal", "standard", "vital_signs", "heart_rate_normal_range", "best_practice", "high", ["age >= 18", "at_rest"], [], ["heart_rate", "pulse", "vital_signs"], "heart_rate", 60.0, 100.0, "Resting adults: 60-100 beats a minute."),
    ("vs_temperature_normal", "standard", "vital_signs", "body_temperature_normal", "best_practice", "high", [], [], ["temperature", "fever", "vital_signs"], "temperature", 36.1, 37.2, "Body temperature 36.1-37.2 degrees Celsius."),
    ("vs_respiratory_rate_normal", "standard", "vital_signs", "respiratory_rate_normal", "best_practice", "high", ["age >= 18", "at_rest"], [], ["respiratory_rate", "breathing", "vital_signs"], "respiratory_rate", 12.0, 20.0, "Resting adults: 12-20 breaths a minute."),
    ("vs_oxygen_saturation_normal", "standard", "vital_signs", "oxygen_saturation_normal", "best_practice", "high", [], [], ["oxygen_saturation", "spo2", "vital_signs"], "oxygen_saturation", 95.0, 100.0, "Saturation 95-100 percent."),
    ("anthro_weight_adult", "standard", "anthropometry", "adult_weight_range", "expert_opinion", "medium", ["age >= 18"], [], ["weight", "anthropometry"], "weight", 40.0, 200.0, "Adults mostly weigh 40-200 kg."),
    ("anthro_height_adult", "standard", "anthropometry", "adult_height_range", "expert_opinion", "medium", ["age >= 18"], [], ["height", "anthropometry"], "height", 140.0, 210.0, "Adults are mostly 140-210 cm tall."),
    ("anthro_bmi_categories", "standard", "anthropometry", "bmi_classification", "systematic_review", "high", ["age >= 18"], ["pregnancy", "athlete", "bodybuilder"], ["bmi", "obesity", "anthropometry"], "bmi", 18.5, 25.0, "Body mass index classes cut at 18.5, 25 and 30."),
    ("lab_glucose_fasting", "standard", "laboratory", "fasting_glucose_normal", "systematic_review", "high", ["fasting >= 8_hours"], [], ["glucose", "diabetes", "laboratory"], "glucose", 70.0, 100.0, "Fasting glucose 70-100 mg/dL."),
    ("lab_hba1c_normal", "standard", "laboratory", "hba1c_normal_range", "systematic_review", "high", [], [], ["hba1c", "diabetes", "laboratory"], "hba1c", 4.0, 5.7, "HbA1c below 5.7 percent."),
    ("age_pediatric_ranges", "standard", "age_specific", "pediatric_vital_signs", "systematic_review", "high", ["age < 18"], [], ["pediatric", "age_specific", "vital_signs"], None, None, None, "Children's vital signs need ranges by age."),
    ("age_geriatric_considerations", "standard", "age_specific", "geriatric_considerations", "cohort_study", "high", ["age >= 65"], [], ["geriatric", "elderly", "age_specific"], None, None, None, "From 65 on, wider ranges can be normal."),
    ("stat_outlier_detection_iqr", "standard", "statistics", "outlier_detection_iqr_method", "best_practice", "high", [], [], ["outliers", "statistics", "data_quality"], None, None, None, "Fences by interquartile range find outliers without a normal shape."),
    ("stat_missing_data_threshold", "standard", "statistics", "missing_data_deletion_threshold", "expert_opinion", "medium", [], [], ["missing_data", "statistics", "data_quality"], None, None, None, "Few gaps can be deleted, many can't."),
    ("clean_duplicate_resolution", "standard", "data_cleaning", "duplicate_record_handling", "best_practice", "medium", [], [], ["duplicates", "data_cleaning"], None, None, None, "Resolve duplicates by a stated rule and keep a record."),
    ("missing_complete_case_analysis", "evidence", "missing_data", "complete_case_analysis", "systematic_review", "high", ["missing_rate < 0.05", "mcar_assumption"], [], ["missing_data", "deletion", "statistical_method"], None, None, None, "Dropping incomplete rows is sound when gaps are few and random."),
    ("missing_mean_imputation_caution", "evidence", "missing_data", "mean_imputation_problems", "systematic_review", "high", [], ["inferential_statistics", "final_analysis"], ["missing_data", "imputation", "caution"], None, None, None, "Filling in means shrinks variance."),
    ("missing_median_imputation_robust", "evidence", "missing_data", "median_imputation", "best_practice", "medium", ["skewed_distribution", "descriptive_analysis"], [], ["missing_data", "imputation", "robust_method"], None, None, None, "Medians stand up to skew and outliers."),
    ("missing_multiple_imputation", "evidence", "missing_data", "multiple_imputation", "systematic_review", "high", ["inferential_statistics", "mar_assumption"], [], ["missing_data", "imputation", "gold_standard"], None, None, None, "Several imputations carry their uncertainty into tests."),
    ("outlier_biological_plausibility", "evidence", "outliers", "biological_plausibility_check", "expert_opinion", "high", [], [], ["outliers", "validation", "medical_data"], None, None, None, "Ask first whether a body can have the value."),
    ("outlier_iqr_method", "evidence", "outliers", "iqr_outlier_detection", "best_practice", "high", ["no_normal_assumption"], [], ["outliers", "iqr", "robust_method"], None, None, None, "Interquartile fences need no normal shape."),
    ("outlier_winsorization", "evidence", "outliers", "winsorization", "best_practice", "medium", [], [], ["outliers", "winsorization", "robust_method"], None, None, None, "Capping keeps rows and tames tails."),
    ("outlier_deletion_caution", "evidence", "outliers", "outlier_deletion_considerations", "expert_opinion", "high", [], [], ["outliers", "deletion", "best_practice"], None, None, None, "Delete outliers only with a reason."),
    ("duplicate_exact_matches", "evidence", "duplicates", "exact_duplicate_handling", "best_practice", "high", [], [], ["duplicates", "data_quality"], None, None, None, "Identical rows can go."),
    ("duplicate_partial_matches", "evidence", "duplicates", "partial_duplicate_handling", "best_practice", "medium", ["manual_review_available"], [], ["duplicates", "data_linkage", "manual_review"], None, None, None, "Rows that agree in part want a look."),
    ("transform_log_skewed", "evidence", "transformation", "log_transformation_skewed_data", "best_practice", "high", ["positive_values", "right_skewed"], ["zero_values", "negative_values"], ["transformation", "normalization", "skewness"], None, None, None, "Logarithms even out a right skew."),
    ("transform_standardization", "evidence", "transformation", "standardization_z_scores", "best_practice", "high", [], [], ["transformation", "standardization", "statistical_method"], None, None, None, "Z scores put columns on one scale."),
    ("sample_size_guideline", "evidence", "study_design", "minimum_sample_size", "expert_opinion", "medium", [], [], ["study_design", "sample_size", "statistics"], None, None, None, "Small samples bound what can be said."),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], SCHEMA)


def rank(c: Column | str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c) if isinstance(c, str) else c)


def search(table: DataFrame, category: str | None = None, topic: str | None = None, tags: list[str] | None = None, min_confidence: str | None = None) -> DataFrame:
    """Rules that meet all of: the category, a part of the topic in any case, any of the tags, the least confidence."""
    if category is not None:
        table = table.where(F.col("category") == category)
    if topic is not None:
        table = table.where(F.lower("topic").contains(topic.lower()))
    if tags:
        table = table.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if min_confidence is not None:
        table = table.where(rank("confidence", CONFIDENCE) <= CONFIDENCE.index(min_confidence) + 1)
    return table


def free_text(table: DataFrame, words: str) -> DataFrame:
    """Rules that hold the words in their id, topic, statement or tags, in any case."""
    return table.where(F.lower(F.concat_ws(" ", "id", "topic", "statement", F.concat_ws(" ", "tags"))).contains(words.lower()))


def best(table: DataFrame) -> DataFrame:
    """The rule of highest confidence, medium at least; the earlier of equals."""
    return search(table, min_confidence="medium").orderBy(rank("confidence", CONFIDENCE), "ordinal").limit(1)


def _true(condition: Column, facts: Column) -> Column:
    """Whether a condition holds: a comparison (name < number) on a fact, or a fact that is there and not zero."""
    parts = F.split(condition, " ")
    fact = F.try_element_at(facts, F.element_at(parts, 1))
    than = F.try_element_at(parts, F.lit(3)).try_cast("double")
    sign = F.try_element_at(parts, F.lit(2))
    compared = F.when(sign == "<", fact < than).when(sign == ">=", fact >= than)
    return F.coalesce(F.when(F.size(parts) == 3, compared).otherwise(fact != 0), F.lit(False))


def _literal(condition: Column, facts: Column) -> Column:
    """The same with conditions looked up whole as names."""
    return F.coalesce(F.try_element_at(facts, condition) != 0, F.lit(False))


def recommend(findings: DataFrame, table: DataFrame, literal: bool = False) -> DataFrame:
    """The best rule of each finding's category, medium confidence at least, for what is known about it.

    findings has finding_id, category and facts (map of name to number). Rules whose conditions all hold and which no
    contraindication rules out come first, all others only where there are none; then confidence, evidence, order.
    """
    holds = _literal if literal else _true
    joined = findings.join(F.broadcast(search(table, min_confidence="medium")), "category")  # the rules are a fixed list
    fits = F.forall("conditions", lambda c: holds(c, F.col("facts"))) & ~F.exists("contraindications", lambda c: holds(c, F.col("facts")))
    order = W.partitionBy("finding_id").orderBy(~fits, rank("confidence", CONFIDENCE), rank("evidence_level", EVIDENCE), "ordinal")
    return joined.withColumns({"applicable": fits, "_place": F.row_number().over(order)}).where("_place = 1").select("finding_id", "category", F.col("id").alias("rule_id"), "confidence", "evidence_level", "applicable")


def contraindicated(findings: DataFrame, table: DataFrame) -> DataFrame:
    """finding_id, rule_id, contraindication: rules on a finding's field whose conditions hold and that something speaks against."""
    joined = findings.join(F.broadcast(table), F.array_contains("tags", F.col("of_field")))  # the rules are a fixed list
    fits = F.forall("conditions", lambda c: _true(c, F.col("facts")))
    against = F.filter("contraindications", lambda c: _true(c, F.col("facts")))
    return joined.where(fits).select("finding_id", F.col("id").alias("rule_id"), F.explode(against).alias("contraindication"))


def reference_ranges(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """The rule and range for each (finding_id, of_field, age).

    Under 18, rules for adults go unless there are no others; from 65 on, geriatric ones are preferred.
    """
    adult = F.array_contains("conditions", F.lit("age >= 18"))
    joined = wanted.join(F.broadcast(table), F.array_contains("tags", F.col("of_field")))  # the rules are a fixed list
    late = F.coalesce((F.col("age") < 18) & adult, F.lit(False))
    old = F.coalesce((F.col("age") >= 65) & F.array_contains("tags", F.lit("geriatric")), F.lit(False))
    order = W.partitionBy("finding_id").orderBy(late, ~old, rank("confidence", CONFIDENCE), "ordinal")
    return joined.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("finding_id", "of_field", "age", F.col("id").alias("rule_id"), "low", "high")


def explain(table: DataFrame) -> DataFrame:
    """id, explanation: what a rule says, when it holds and what speaks against it."""
    when = F.when(F.size("conditions") > 0, F.concat(F.lit(" When: "), F.concat_ws(", ", "conditions"), F.lit(".")))
    unless = F.when(F.size("contraindications") > 0, F.concat(F.lit(" Not with: "), F.concat_ws(", ", "contraindications"), F.lit(".")))
    basis = F.concat(F.lit(" Basis: "), "evidence_level", F.lit(", confidence "), "confidence", F.lit("."))
    return table.select("id", F.concat(F.col("statement"), F.coalesce(when, F.lit("")), F.coalesce(unless, F.lit("")), basis).alias("explanation"))
