"""A delimited file of our own: a small sleep study with gaps, impossible values, a late correction and copies."""

HEADER = "subject,site,patient_id,age,sex,heart_rate,systolic_bp,sleep_hours,caffeine_mg,enrollment_date,visit_date,remark"

ROWS = 36
#: Rows with a defect: row to (column, cell).
DEFECTS = {2: ("sleep_hours", "NA"), 5: ("caffeine_mg", ""), 9: ("age", "-1"), 14: ("sex", "null"), 17: ("heart_rate", "900"), 21: ("caffeine_mg", "NA"), 23: ("visit_date", "2022-11-02"), 26: ("age", "131"), 30: ("sleep_hours", "")}


def visits_csv() -> str:
    lines = [HEADER]
    for i in range(ROWS):
        row = {
            "subject": i, "site": ["north", "south", "west"][i % 3], "patient_id": f"S-{700 + 7 * i}", "age": 21 + (i * 5) % 44, "sex": "fm"[i % 2], "heart_rate": 58 + (i * 3) % 31, "systolic_bp": 104 + (i * 7) % 29,
            "sleep_hours": 5 + (i * 11) % 40 / 10, "caffeine_mg": 40 * (i % 6), "enrollment_date": f"2023-03-{1 + i % 28:02d}", "visit_date": f"2023-05-{1 + (i * 2) % 28:02d}", "remark": f'"woke twice, ""restless"" {i}"',
        }
        if i in DEFECTS:
            row[DEFECTS[i][0]] = DEFECTS[i][1]
        lines.append(",".join(map(str, row.values())))
        if i % 10 == 4:
            lines.append("")
    return "\n".join(lines) + "\n"
