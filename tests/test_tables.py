import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tablecare.functions import cells as C
from tablecare.functions import stats
from tablecare.functions.stats import quantile, quantiles
from tablecare.operators import clean, issues, pipeline, profile, quality, rules, validate
from tablecare.plans.fixtures import AS_OF, frame
from tablecare.sources import files

from .fixtures import DEFECTS, ROWS, visits_csv


@pytest.fixture(scope="module")
def visits(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "visits.csv"
    path.write_text(visits_csv())
    df = files.read_table(spark, str(path))
    return df.drop("_row_id").withColumn("row_id", F.col("subject").cast("long")).drop("subject")


def test_reading_files(spark, visits, tmp_path):
    assert visits.count() == ROWS and len(profile.data_columns(visits)) == 11
    by = {r.row_id: r for r in visits.collect()}
    assert by[2].sleep_hours is None and by[5].caffeine_mg is None and by[14].sex is None
    assert by[1].remark == 'woke twice, "restless" 1' and by[1].patient_id == "S-707"
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")
    (tmp_path / "a.tsv").write_text("a\tb\n1\n2\t3\t4\n")
    (tmp_path / "b.tsv").write_text("a\tb\n5\t6\n")
    got = files.read_table(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert sorted((r.a, r.b) for r in got.collect()) == [("1", None), ("2", "3"), ("5", "6")]
    assert files.dataset("d", "ehr", ["x"])["dataset_type"] == "clinical_trial"
    with pytest.raises(ValueError):
        files.dataset("d", "clinical_trial", [])


def test_round_trips(spark, visits, tmp_path):
    files.write_csv(visits, str(tmp_path / "out.csv"))
    back = files.read_table(spark, str(tmp_path / "out.csv"), separator=",", row_id=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, visits.select([F.col(c).cast("string").alias(c) for c in visits.columns]).collect()))
    gone = clean.deletion_lineage(visits.limit(2))
    assert files.export(gone, str(tmp_path / "lineage"), partition_by="operation") == 22
    assert files.export(gone, str(tmp_path / "lineage"), partition_by="operation") == 44
    report = quality.assess(visits, AS_OF)
    files.write_metadata(spark, str(tmp_path / "meta"), "in", "out", "me", report, 3)
    assert spark.read.json(str(tmp_path / "meta")).first().operation_count == 3
    files.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n_rows == ROWS


def test_scores_of_a_small_file(visits):
    r = quality.assess(visits, AS_OF).first()
    gaps = sum(cell in ("", "NA", "null") for _, cell in DEFECTS.values())
    assert r.completeness == pytest.approx(1 - gaps / (ROWS * 11)) and r.uniqueness == 1 and r.consistency == pytest.approx(1 - 1 / ROWS)
    numeric = profile.numeric_columns(visits)
    assert numeric == ["age", "heart_rate", "systolic_bp", "sleep_hours", "caffeine_mg"]
    out = {x.column: x.extremes for x in quality.extremes(visits, numeric).collect()}
    assert out == {"age": 1, "heart_rate": 1, "systolic_bp": 0, "sleep_hours": 0, "caffeine_mg": 0}
    assert r.validity == pytest.approx(1 - (1 + 2) / (ROWS * 5))  # one negative age, one extreme age and heart rate
    assert r.overall == pytest.approx(0.25 * r.completeness + 0.25 * r.validity + 0.2 * r.consistency + 0.2 + 0.1)
    assert quality.assess(visits, AS_OF, dates=[]).first().overall == pytest.approx(0.3 * r.completeness + 0.3 * r.validity + 0.2 * r.consistency + 0.2)


def test_pipeline_on_a_small_file(visits):
    done = pipeline.run(visits, AS_OF)
    rows = {r.row_id: r for r in done.table.collect()}
    ways = {c: way for c, _, _, way in done.decisions}
    assert set(ways) == {"age", "sex", "heart_rate", "sleep_hours", "caffeine_mg"}
    dropped = {i for i, (c, _) in DEFECTS.items() if ways.get(c) == "drop" and c != "visit_date"}
    assert set(rows) == set(range(ROWS)) - dropped
    assert [i for i, r in rows.items() if r.date_inconsistency_flag] == [23]
    lineage = done.lineage.collect()
    assert sorted(r.record_id for r in lineage if r.operation == "correction") == ["S-763", "S-819", "S-882"]
    assert sorted({r.row_id for r in lineage if r.operation == "deletion"}) == sorted(dropped)
    assert sum(r.operation == "deletion" for r in lineage) == 11 * len(dropped)
    report = done.report.first()
    assert report.lineage_count == len(lineage) > 0 and report.operation_count == done.audit.count()
    assert report.score_after > report.score_before and report.rows_in == ROWS and report.rows_out == ROWS - len(dropped)


def test_a_dropped_row_can_be_rebuilt(spark):
    df = spark.createDataFrame([(i, f"P{i}", float(i % 7), None if i == 50 else "x") for i in range(100)], "row_id long, patient_id string, a double, b string")
    table, lineage, decisions = clean.handle_missing(df)
    assert [d[0] for d in decisions] == ["b"] and decisions[0][3] == "drop" and table.count() == 99
    assert {(r.row_id, r.field, r.original_value, r.evidence_id) for r in lineage.collect()} == {(50, c, v, "missing_complete_case_analysis") for c, v in (("patient_id", "P50"), ("a", "1.0"), ("b", None))}


def test_pipeline_equals_its_steps(spark, sf):
    df = frame(spark, sf, "visits")
    done = pipeline.run(df, AS_OF)
    kept, gone = clean.drop_duplicates(df)
    assert kept.count() + gone.count() == df.count()
    pdf = clean.fix_outliers(kept)[0].toPandas().sort_values("row_id")
    for column, n, rate, way in done.decisions:
        gap = pdf[column].isna()
        assert gap.sum() == n and gap.mean() == pytest.approx(rate)
        if way == "drop":
            pdf = pdf[~gap]
        elif way == "median":
            x = sorted(pdf[column].dropna())
            pdf[column] = pdf[column].fillna((x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2)
        else:
            pdf[f"{column}_missing_flag"] = gap
    got = done.table.toPandas().sort_values("row_id")
    assert list(got.row_id) == list(pdf.row_id)
    for column in pdf.columns:
        assert [None if x != x else x for x in got[column]] == [None if x != x else x for x in pdf[column]]


def test_lineage_replays_to_the_original(spark, sf):
    df = frame(spark, sf, "visits")
    fixed, changes = clean.fix_outliers(df)
    undo = {(r.row_id, r.field): float(r.original_value) for r in changes.collect()}
    before = {r.row_id: r.asDict() for r in df.collect()}
    for r in fixed.collect():
        for c, v in r.asDict().items():
            assert before[r.row_id][c] == undo.get((r.row_id, c), v)
    assert undo


def test_dedupe_is_idempotent(spark, sf):
    once = clean.drop_duplicates(frame(spark, sf, "visits"))[0]
    again, gone = clean.drop_duplicates(once)
    assert gone.count() == 0 and again.count() == once.count()


def test_snapshot_and_sequential_agree_on_one_column(spark, sf):
    df = frame(spark, sf, "visits").select("row_id", "weight", "temperature")
    a, b = (clean.handle_missing(df, mode=m)[0].orderBy("row_id").collect() for m in ("sequential", "snapshot"))
    assert a == b


@pytest.mark.parametrize("seed", range(3))
def test_quantiles(spark, seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 4, 5, 8, 11):
        x = sorted(rng.choice([1.0, 2.5, 7.0, rng.random()]) for _ in range(n))
        got = spark.createDataFrame([(v,) for v in x], "x double").agg(*[quantile("x", p) for p in (0.25, 0.5, 0.75)]).first()
        for p, q in zip((0.25, 0.5, 0.75), got, strict=True):
            i = n * p
            assert q == (x[int(i) - 1] + x[int(i)]) / 2 if i == int(i) else q == x[int(i)]


@pytest.mark.parametrize("few,accuracy", [(20_000, 20_000), (3, 8)])
def test_quantiles_by_search_equal_sorting(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(stats, "FEW_VALUES", few)  # windows with more values are narrowed step by step
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    rng = random.Random(7)
    columns = [[rng.gauss(0, 5) for _ in range(400)], [rng.choice([1.0, 1.0, 1.0, 2.5, -3.0]) for _ in range(400)], [4.0] * 400, [None if rng.random() < 0.7 else float(rng.randint(-20, 20)) for _ in range(400)], [None] * 400, [1e300 * rng.random() for _ in range(400)], [None] * 399 + [2.0]]
    df = spark.createDataFrame(list(zip(range(400), *columns, strict=True)), "id int, " + ", ".join(f"x{i} double" for i in range(len(columns))))
    ps = (0.01, 0.25, 0.5, 0.99)
    got = quantiles(df, [f"x{i}" for i in range(len(columns))], ps)
    for i, column in enumerate(columns):
        x = sorted(v for v in column if v is not None)
        n, values = got[f"x{i}"]
        assert n == len(x)
        if not x:
            assert values == [None] * 4
            continue
        for p, q in zip(ps, values, strict=True):
            low, high = x[math.ceil(n * p) - 1], x[n - math.ceil(n * (1 - p))]
            assert q == pytest.approx((low + high) / 2, rel=1e-12), (i, p)


def test_duplicates_by_aggregates_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a", "b"]), rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k string, n double, t string")
    cells = lambda r: tuple("" if v is None else str(v) for v in r[1:])
    for keep in ("first", "last", "complete"):
        gaps = lambda r: sum(v in (None, "") for v in r[1:])
        order = {"first": lambda r: r[0], "last": lambda r: -r[0], "complete": lambda r: (gaps(r), r[0])}[keep]
        left, best = {}, {}
        for r in sorted(rows, key=order):
            left.setdefault(cells(r), r)
        for r in sorted(left.values(), key=order):
            best.setdefault(cells(r)[:1], r)
        kept, gone = clean.drop_duplicates(df, ["k"], keep)
        assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == sorted(best.values(), key=lambda r: r[0])
        assert {r.row_id: r._operation for r in gone.collect()} == {r[0]: "composite_duplicate" if r in left.values() else "exact_duplicate" for r in rows if r not in best.values()}
    n = {}
    for r in rows:
        n[cells(r)[0]] = n.get(cells(r)[0], 0) + 1
    assert {r.row_id: r.duplicate_flag for r in clean.flag_duplicates(df, ["k"]).collect()} == {r[0]: n[cells(r)[0]] > 1 for r in rows}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tablecare.functions.storage import shared_folder

    unset = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: unset, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=context))


def test_empty_and_constant_tables(spark):
    empty = spark.createDataFrame([], "row_id long, patient_id string, age double, visit_date date")
    r = quality.assess(empty, AS_OF, dates=[]).first()
    assert r.completeness == 0 and r.overall == pytest.approx(0.7) and r.level == "fair"
    assert issues.detect(empty).count() == 0
    same = spark.createDataFrame([(i, 1.0, None if i % 2 else 2.0) for i in range(20)], "row_id long, a double, b double")
    found = {x.column: x for x in issues.gap_statistics(same, ["a", "b"], ["a", "b"]).collect()}
    assert found["b"].mcar and found["b"].mean_correlation is None


def test_numbers_and_dates(spark):
    texts = [" 12 ", "1e3", "12d", "NaN", "0x1F", " ", "-.5", "Infinity", "7.", None]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.parse_number(F.col("t")).alias("x")).collect()]
    assert got == [12.0, 1000.0, None, None, None, None, -0.5, None, 7.0, None]
    days = spark.createDataFrame([("2024-02-03",), ("03.02.2024",), ("2024/02/03",), ("soon",)], "t string").select(C.parse_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in days] == [date(2024, 2, 3)] * 3 + [None]


def test_rule_conditions(spark):
    table = rules.rules(spark)
    facts = lambda **k: spark.createDataFrame([(1, "missing_data", {a: float(b) for a, b in k.items()})], "finding_id long, category string, facts map<string,double>")
    pick = lambda literal=False, **k: rules.recommend(facts(**k), table, literal).first().rule_id
    assert pick(missing_rate=0.01, mcar_assumption=1) == "missing_complete_case_analysis"
    assert pick(missing_rate=0.3, mcar_assumption=1) == "missing_mean_imputation_caution"
    assert pick(True, missing_rate=0.01, mcar_assumption=1) == "missing_mean_imputation_caution"
    assert rules.best(rules.search(table, tags=["bmi"])).first().id == "anthro_bmi_categories"


def test_streams_and_validation_of_streams(spark, tmp_path):
    from tablecare.streaming import events

    base = spark.createDataFrame([(i, i % 3, ["view", "error"][i % 2]) for i in range(20)], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 40_000))
    base.write.parquet(str(tmp_path / "in"))
    stream = events.follow(spark, str(tmp_path / "in"), base.schema, job=1)
    events.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == base.where("user_id = 1").count()
    base.withColumn("event_id", F.col("event_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    events.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * base.where("user_id = 1").count()
    late = events.windowed_counts(events.follow(spark, str(tmp_path / "in"), base.schema))
    q = late.writeStream.format("memory").queryName("late").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("late").collect()) == 40


def test_required_fields(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 3.0)], "row_id long, a string, b double")
    got = {r.row_id: r.missing_fields for r in validate.required(df, ["a", "b", "c"]).collect()}
    assert got == {1: ["b", "c"], 2: ["a", "c"]}


def test_many_columns_with_gaps(spark):
    rng = random.Random(4)
    rows = [tuple([i, *[None if rng.random() < 0.08 else rng.random() for _ in range(11)]]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"c{i} double" for i in range(11)))
    out, lineage, decisions = clean.handle_missing(df)
    assert len(decisions) >= 10 and out.count() <= 60
    assert lineage.count() == sum(n if way == "median" else 11 * n for _, n, _, way in decisions if way in ("median", "drop"))
