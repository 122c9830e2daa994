"""Ranges, aliases and thresholds of clinical tables."""

#: Values outside are physically impossible: column names, low, high.
IMPOSSIBLE = (
    (("age", "patient_age"), 0, 120),
    (("systolic_bp", "blood_pressure_systolic", "bp_systolic", "sbp"), 30, 300),
    (("diastolic_bp", "blood_pressure_diastolic", "bp_diastolic", "dbp"), 10, 200),
    (("heart_rate", "hr", "pulse"), 15, 250),
    (("temperature", "temp", "body_temperature", "body_temp"), 25, 45),
    (("weight_kg", "weight"), 0.3, 500),
    (("height_cm", "height"), 20, 280),
)
#: Plausible vital signs: field, low, high.
PLAUSIBLE = (
    ("systolic_bp", 70, 200),
    ("diastolic_bp", 40, 130),
    ("heart_rate", 40, 150),
    ("temperature", 35, 42),
    ("respiratory_rate", 8, 30),
    ("oxygen_saturation", 70, 100),
)
#: Normal vital signs for issues: aliases, low, high, rule.
NORMAL = (
    (("systolic_bp", "blood_pressure_systolic", "bp_systolic", "sbp"), 90, 120, "vs_blood_pressure_normal"),
    (("diastolic_bp", "blood_pressure_diastolic", "bp_diastolic", "dbp"), 60, 80, "vs_blood_pressure_normal"),
    (("heart_rate", "hr", "pulse"), 60, 100, "vs_heart_rate_normal"),
    (("temperature", "temp", "body_temperature", "body_temp"), 36.1, 37.2, "vs_temperature_normal"),
)
#: Laboratory ranges: test, context, unit, low, high. The first context of a test is its default.
LAB = (
    ("glucose", "fasting", "mg/dL", 70.0, 100.0),
    ("glucose", "random", "mg/dL", 70.0, 200.0),
    ("hba1c", "any", "%", 4.0, 5.6),
    ("hemoglobin", "m", "g/dL", 13.5, 17.5),
    ("hemoglobin", "f", "g/dL", 12.0, 15.5),
    ("creatinine", "m", "mg/dL", 0.7, 1.3),
    ("creatinine", "f", "mg/dL", 0.6, 1.1),
)
#: Values from which a result points to a disease: test, value, note.
LAB_NOTES = (("glucose", 126.0, "diabetes"), ("hba1c", 6.5, "diabetes"), ("glucose", 100.0, "prediabetes"), ("hba1c", 5.7, "prediabetes"))
#: Body mass index: below, class.
BMI_CLASSES = ((16.0, "severely_low"), (18.5, "underweight"), (25.0, "normal"), (30.0, "overweight"), (40.0, "obese"))

AGE_NAMES = ("age", "patient_age")
ENROLL_NAMES = ("enrollment_date", "enroll_date", "start_date")
VISIT_NAMES = ("visit_date", "assessment_date")
DATE_NAMES = ("enrollment_date", "visit_date", "completion_date", "birth_date")
NEGATIVE_CHECKED = ("age", "weight", "height", "bmi", "systolic_bp", "diastolic_bp", "heart_rate")
DATE_PAIRS = (("enrollment_date", "visit_date"), ("enrollment_date", "completion_date"), ("birth_date", "enrollment_date"))

#: Shares of missing cells from which a column is a finding, and by which it is treated.
MISSING_SEVERE, MISSING_NOTED, DROP_BELOW, MEDIAN_BELOW = 0.20, 0.05, 0.05, 0.20
#: Interquartile ranges to a fence, values that fences need at least, mean |correlation| below which gaps count as random.
FENCE, FENCE_VALUES, MCAR_BELOW, MCAR_ROWS = 3.0, 4, 0.1, 10
BMI_TOLERANCE, AGE_TOLERANCE, DAYS_A_YEAR, STALE_DAYS = 2.0, 2.0, 365.25, 5 * 365
