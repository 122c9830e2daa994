"""Cleaning plans for many datasets: profiles and objectives to ordered steps, dependencies and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ("validation", "cleaning", "transformation", "verification")
PRIORITIES = ("critical", "high", "medium", "low")
#: Words in an objective, and the kind of step that they ask for.
KEYWORDS = (
    ("normaliz", "normalize"), ("standardiz", "normalize"), ("transform", "normalize"),
    ("valid", "ranges"), ("range", "ranges"), ("plausib", "ranges"),
    ("dedup", "duplicates"), ("duplicate", "duplicates"), ("unique", "duplicates"),
    ("missing", "missing"), ("impute", "missing"), ("null", "missing"), ("na ", "missing"),
    ("format", "formats"), ("type", "formats"), ("coerce", "formats"), ("parse", "formats"),
)
#: kind, name, type, priority, required, risk, place among the steps of objectives.
OBJECTIVE_STEPS = (
    ("normalize", "normalize columns", "transformation", "medium", False, "low", 0),
    ("ranges", "check value ranges", "validation", "high", False, "low", 1),
    ("duplicates", "remove duplicates", "cleaning", "high", True, "medium", 2),
    ("missing", "handle missing values", "cleaning", "high", False, "low", 3),
    ("formats", "unify formats", "transformation", "medium", False, "low", 4),
)
FIRST_STEPS = (("profile", "profile columns", "validation", "critical", True, "low", 0), ("schema", "check schema and types", "validation", "critical", True, "low", 1))
LAST_STEPS = (("reassess", "assess quality again", "verification", "high", True, "low", 0), ("report", "write the report", "verification", "medium", True, "low", 1))

STEP = "dataset_id string, kind string, name string, step_type string, priority string, required boolean, risk string, field string, place long"
COLUMNS = ["dataset_id", "kind", "name", "step_type", "priority", "required", "risk", "field", "place"]


def _constant(df: DataFrame, steps, base: int) -> DataFrame:
    """The steps for each dataset of df."""
    parts = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(t).alias("step_type"), F.lit(p).alias("priority"), F.lit(r).alias("required"), F.lit(risk).alias("risk"), F.lit(None).cast("string").alias("field"), F.lit(base + i).cast("long").alias("place")) for k, n, t, p, r, risk, i in steps]))
    return df.select("dataset_id", parts)


def _named(a: str, c: Column) -> Column:
    return F.concat(F.lit(a + ": "), c)


def profile_steps(profiles: DataFrame) -> DataFrame:
    """Steps for gaps, outliers and duplicates in column profiles (dataset_id, ordinal, column, missing_rate, outlier_count, duplicate_count, is_key_column)."""
    rate = F.col("missing_rate")
    gaps = profiles.where(rate > 0).select("dataset_id", F.lit("missing").alias("kind"), _named("handle missing values", F.col("column")).alias("name"), F.lit("cleaning").alias("step_type"), F.when(rate > 0.1, "high").otherwise("medium").alias("priority"), F.lit(False).alias("required"), F.when(rate > 0.2, "medium").otherwise("low").alias("risk"), F.col("column").alias("field"), (F.col("ordinal") * 2 + 100).cast("long").alias("place"))
    outliers = profiles.where("outlier_count > 0").select("dataset_id", F.lit("outliers").alias("kind"), _named("handle outliers", F.col("column")).alias("name"), F.lit("cleaning").alias("step_type"), F.lit("medium").alias("priority"), F.lit(False).alias("required"), F.lit("medium").alias("risk"), F.col("column").alias("field"), (F.col("ordinal") * 2 + 101).cast("long").alias("place"))
    keys = profiles.where("duplicate_count > 0 AND is_key_column").groupBy("dataset_id").agg(F.max("duplicate_count").alias("most"))
    twice = keys.select("dataset_id", F.lit("duplicates").alias("kind"), F.lit("remove duplicates").alias("name"), F.lit("cleaning").alias("step_type"), F.lit("high").alias("priority"), F.lit(True).alias("required"), F.lit("medium").alias("risk"), F.lit(None).cast("string").alias("field"), F.lit(100_000).cast("long").alias("place"))
    return gaps.union(outliers).union(twice)


def warnings(profiles: DataFrame) -> DataFrame:
    """dataset_id, column: more than a fifth missing."""
    return profiles.where("missing_rate > 0.2").select("dataset_id", "column", "missing_rate")


def objective_steps(objectives: DataFrame, existing: DataFrame) -> DataFrame:
    """Steps that objectives (dataset_id, objective) ask for in words; duplicates and gaps only where no step is there."""
    spark = objectives.sparkSession
    words = spark.createDataFrame(list(KEYWORDS), "word string, kind string")
    steps = spark.createDataFrame(list(OBJECTIVE_STEPS), "kind string, name string, step_type string, priority string, required boolean, risk string, place int")
    asked = objectives.join(F.broadcast(words), F.lower("objective").contains(F.col("word"))).select("dataset_id", "kind").distinct()  # a fixed list
    there = existing.where(F.col("kind").isin("duplicates", "missing")).select("dataset_id", "kind").distinct()
    asked = asked.join(there, ["dataset_id", "kind"], "left_anti")
    return asked.join(F.broadcast(steps), "kind").select("dataset_id", "kind", "name", "step_type", "priority", "required", "risk", F.lit(None).cast("string").alias("field"), (F.col("place") + 200_000).cast("long").alias("place"))  # a fixed list


def order_steps(steps: DataFrame) -> DataFrame:
    """step_id in order of type, priority and place; depends_on: the validation steps, for all others."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    numbered = steps.withColumn("step", F.row_number().over(W.partitionBy("dataset_id").orderBy(rank("step_type", TYPES), rank("priority", PRIORITIES), "place", "kind")))
    name = F.concat(F.lit("step-"), F.lpad(F.col("step").cast("string"), 3, "0"))
    checks = F.sort_array(F.collect_list(F.when(F.col("step_type") == "validation", name)).over(W.partitionBy("dataset_id")))
    return numbered.withColumns({"step_id": name, "depends_on": F.when(F.col("step_type") == "validation", F.lit("")).otherwise(F.concat_ws(",", checks))})


def plan(profiles: DataFrame, objectives: DataFrame) -> DataFrame:
    """All steps of every dataset of the profiles, in order."""
    sets = profiles.select("dataset_id").distinct()
    found = profile_steps(profiles)
    every = _constant(sets, FIRST_STEPS, 0).union(found).union(objective_steps(objectives, found)).union(_constant(sets, LAST_STEPS, 300_000))
    return order_steps(every).select("dataset_id", "step_id", "kind", "name", "step_type", "priority", "required", "risk", "field", "depends_on")


def estimate(steps: DataFrame) -> DataFrame:
    """dataset_id, steps, improvement, data_loss, loss_warning."""
    one = steps.groupBy("dataset_id").agg(F.count("*").alias("steps"), F.count_if(F.col("step_type") == "cleaning").alias("cleaning"), F.count_if(F.col("risk") != "low").alias("risky"))
    return one.select("dataset_id", "steps", F.round(F.least(0.05 + 0.07 * F.col("cleaning"), F.lit(0.5)), 2).alias("improvement"), F.round(F.least(0.02 * F.col("risky"), F.lit(0.15)), 3).alias("data_loss"), (F.least(0.02 * F.col("risky"), F.lit(0.15)) > 0.05).alias("loss_warning"))


def objectives_of(issues: DataFrame) -> DataFrame:
    """dataset_id, objective for every critical or high issue (dataset_id, severity, code, field)."""
    return issues.where(F.col("severity").isin("critical", "high")).select("dataset_id", F.concat_ws(" ", "category", "code", F.lit("in"), "field").alias("objective"))
