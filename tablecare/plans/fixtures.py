"""Tables with the usual defects, derived from the given ones by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2024, 6, 1)

#: Visits with gaps, impossible values, wrong dates and duplicates.
VISITS = """
WITH base AS (
  SELECT o_orderkey * 2 AS row_id,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'P' || CAST(o_custkey AS STRING) END AS patient_id,
    CAST(CASE WHEN o_orderkey % 211 = 0 THEN -5 WHEN o_orderkey % 223 = 0 THEN 200
         WHEN o_orderkey % 41 = 0 THEN NULL ELSE 18 + o_custkey % 70 END AS DOUBLE) AS age,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CAST(CASE WHEN o_orderkey % 307 = 0 THEN 999 WHEN o_orderkey % 37 = 0 THEN NULL ELSE 95 + o_orderkey % 60 END AS DOUBLE) AS systolic_bp,
    CAST(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 55 + o_orderkey % 50 END AS DOUBLE) AS heart_rate,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(360 + o_orderkey % 25 AS DOUBLE) / 10 END AS temperature,
    CAST(45 + o_custkey % 60 AS DOUBLE) AS weight,
    CAST(150 + o_custkey % 45 AS DOUBLE) AS height,
    o_totalprice AS lab_value,
    CAST(o_orderdate AS DATE) AS enrollment_date,
    CASE WHEN o_orderkey % 59 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 DAY AS DATE)
         ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 31 DAY AS DATE) END AS visit_date
  FROM orders)
SELECT * FROM base
UNION ALL
SELECT row_id + 1, patient_id, age, gender, systolic_bp, heart_rate, temperature, weight, height, lab_value, enrollment_date, visit_date
FROM base WHERE row_id % 106 = 0
"""

#: Text cells as files have them.
CELLS = """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 12 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN '12d' WHEN 4 THEN '1e3' WHEN 5 THEN '0x1F'
       WHEN 6 THEN 'abc' WHEN 7 THEN '-3.5' WHEN 8 THEN '+7' WHEN 9 THEN '.5' ELSE CAST(o_custkey AS STRING) END AS cell,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS digits,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderpriority END AS words,
  CAST(NULL AS STRING) AS nothing
FROM orders
"""

#: Patients with weight, height, body mass index and several dates.
PATIENTS = """
SELECT o_orderkey AS row_id, 'P' || CAST(o_custkey AS STRING) AS patient_id,
  CAST(20 + o_custkey % 60 AS DOUBLE) AS age,
  CAST(45 + o_custkey % 60 AS DOUBLE) AS weight,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(150 + o_custkey % 45 AS DOUBLE) ELSE CAST(150 + o_custkey % 45 AS DOUBLE) / 100 END AS height,
  round(CAST(45 + o_custkey % 60 AS DOUBLE) / power(CAST(150 + o_custkey % 45 AS DOUBLE) / 100, 2), 1) + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END AS bmi,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST(DATE '1960-05-17' AS DATE) ELSE CAST(DATE '2024-06-01' - INTERVAL 12000 DAY AS DATE) END AS birth_date,
  CAST(o_orderdate AS DATE) AS enrollment_date,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 DAY AS DATE) ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 31 DAY AS DATE) END AS visit_date,
  CASE WHEN o_orderkey % 71 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 DAY AS DATE) WHEN o_orderkey % 73 = 0 THEN DATE '2030-01-01' ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) END AS completion_date
FROM orders
"""

#: Laboratory results and codes.
LABS = """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'glucose' WHEN 1 THEN 'hba1c' WHEN 2 THEN 'hemoglobin' ELSE 'creatinine' END AS test,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(60 + o_custkey % 160 AS DOUBLE) WHEN 1 THEN CAST(35 + o_custkey % 40 AS DOUBLE) / 10 WHEN 2 THEN CAST(100 + o_custkey % 90 AS DOUBLE) / 10 ELSE CAST(4 + o_custkey % 14 AS DOUBLE) / 10 END AS value,
  CASE WHEN o_orderkey % 31 = 0 THEN 'mmol/L' WHEN o_orderkey % 4 IN (0, 3) THEN 'mg/dL' WHEN o_orderkey % 4 = 1 THEN '%' ELSE 'g/dL' END AS unit,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS fasting,
  CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS sex,
  CASE o_orderkey % 6 WHEN 0 THEN 'A01' WHEN 1 THEN 'e11.9' WHEN 2 THEN 'Z99.123' WHEN 3 THEN 'I10.25' WHEN 4 THEN NULL ELSE '9X1' END AS icd10
FROM orders
"""

#: Column profiles of many datasets: one for each customer nation and market segment.
PROFILES = """
SELECT CAST(c_nationkey AS STRING) AS dataset_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS ordinal, c_mktsegment AS "column",
  CAST(count(*) % 7 AS DOUBLE) / 20 AS missing_rate, count(*) % 3 AS outlier_count, count(*) % 4 AS duplicate_count, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_key_column
FROM customer GROUP BY c_nationkey, c_mktsegment
"""

#: What is asked for each dataset.
OBJECTIVES = """
SELECT CAST(n_nationkey AS STRING) AS dataset_id,
  CASE n_nationkey % 6 WHEN 0 THEN 'Deduplicate records' WHEN 1 THEN 'Impute missing labs' WHEN 2 THEN 'Normalize units and validate ranges' WHEN 3 THEN 'Parse date formats' WHEN 4 THEN 'Keep unique patients; NULL checks' ELSE 'Nothing else' END AS objective
FROM nation
"""

TABLES = {"visits": (VISITS, "orders"), "cells": (CELLS, "orders"), "patients": (PATIENTS, "orders"), "labs": (LABS, "orders"), "profiles": (PROFILES, "customer"), "objectives": (OBJECTIVES, "nation")}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = TABLES[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}").replace('"column"', "`column`"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def sql(*names: str, rest: str) -> str:
    """A DuckDB query over derived tables."""
    parts = ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names)
    return f"WITH {parts}{' ' if rest.lstrip().upper().startswith('SELECT') else ', '}{rest}"
