"""Gap statistics and sequential decisions against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecare.functions import cells, stats
from tablecare.operators import clean, gaps, issues, lineage, pipeline, profile, quality
from tablecare.plans.fixtures import AS_OF, frame


def table(spark, seed, n=400, columns=9):
    """Numbers and texts with gaps, some of them where another column is large."""
    rng = np.random.default_rng(seed)
    data = {"row_id": np.arange(n)}
    for i in range(columns):
        x = rng.normal(10 * i, 1 + i, n).round(3)
        gone = rng.random(n) < rng.choice([0, 0.01, 0.03, 0.1, 0.3])
        if i and rng.random() < 0.4:
            gone |= (data[f"c{i - 1}"] > np.nanquantile(data[f"c{i - 1}"], 0.9)) & (rng.random(n) < 0.5)
        data[f"c{i}"] = np.where(gone, np.nan, x)
    data["one"] = np.where(rng.random(n) < 0.1, np.nan, 0.1)
    pdf = pd.DataFrame(data)
    pdf["t"] = [None if x < 0.04 else "x" for x in rng.random(n)]
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    kinds = ["row_id long", *[f"c{i} double" for i in range(columns)], "one double", "t string"]
    return spark.createDataFrame(rows, ", ".join(kinds)), pdf


def correlation(pdf, column, numbers):
    found = []
    for n in numbers:
        x = pdf[n].dropna()
        flag = pdf.loc[x.index, column].isna().astype(float)
        if n != column and len(x) >= 10 and x.max() > x.min() and 0 < flag.sum() < len(x):
            found.append(abs(np.corrcoef(flag, x)[0, 1]))
    return sum(found) / len(found) if found else None


def in_sequence(pdf, columns, numbers):
    """The clean of gaps column by column, by definition."""
    pdf, out = pdf.copy(), []
    for c in columns:
        gone = int(pdf[c].isna().sum())
        if not gone:
            continue
        rate, mean = gone / len(pdf), correlation(pdf, c, numbers)
        way = "drop" if rate < 0.05 and (mean is None or mean < 0.1) else ("median" if c in numbers else "flag") if rate < 0.2 else "flag"
        out.append((c, gone, rate, way))
        if way == "drop":
            pdf = pdf[pdf[c].notna()]
        elif way == "median":
            pdf[c] = pdf[c].fillna(pdf[c].median())
        else:
            pdf[f"{c}_missing_flag"] = pdf[c].isna()
    return pdf, out


@pytest.mark.parametrize("seed", range(5))
def test_sequential_decisions_equal_the_plain_loop(spark, seed):
    df, pdf = table(spark, seed)
    columns, numbers = [c for c in pdf.columns if c != "row_id"], [c for c in pdf.columns if c not in ("row_id", "t")]
    want, decided = in_sequence(pdf, columns, numbers)
    got, changes, decisions = clean.handle_missing(df)
    assert [(c, n, way) for c, n, _, way in decisions] == [(c, n, way) for c, n, _, way in decided]
    assert [r for _, _, r, _ in decisions] == pytest.approx([r for _, _, r, _ in decided])
    a, b = got.toPandas().set_index("row_id").sort_index(), want.set_index("row_id").sort_index()
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False)
    back = lineage.restore(got, changes, columns).toPandas().set_index("row_id").sort_index()
    pd.testing.assert_frame_equal(back, pdf.set_index("row_id"), check_dtype=False)
    again = lineage.replay(df, changes, columns).toPandas().set_index("row_id").sort_index()
    pd.testing.assert_frame_equal(again, a[columns], check_dtype=False)


def test_gap_matrix_of_many_columns_equals_corr(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, (200, 300)) + 1e6 * (np.arange(300) % 3)
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in x.tolist()], ", ".join(f"c{i} double" for i in range(300)))
    found = {r.column: r for r in issues.gap_statistics(df, list(pdf.columns), list(pdf.columns)).collect()}
    flags, filled = pdf.isna().astype(float), pdf
    for c in list(pdf.columns)[::37]:
        assert found[c].missing_count == flags[c].sum()
        assert found[c].mean_correlation == pytest.approx(correlation(pdf, c, list(filled.columns)), rel=1e-6)


def jobs(spark, work):
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_columns(spark):
    few, many = ([spark.range(60).select(*[F.when(F.rand(i) < 0.9, F.rand(i + 1)).alias(f"c{i}") for i in range(n)]) for n in (4, 60)])
    count = [jobs(spark, lambda d=d: gaps.held(d, d.columns, d.columns)) for d in (few, many)]
    assert count[0] == count[1] <= 6


def test_filling_by_formula_equals_counting_again(spark):
    df, pdf = table(spark, 11)
    numbers = [c for c in pdf.columns if c not in ("row_id", "t")]
    held = gaps.held(df, [*numbers, "t"], numbers)
    for c, v in (("c1", 12.5), ("c4", -3.0), ("one", 0.1), ("c7", 70.0)):
        held.fill(c, v)
        pdf[c] = pdf[c].fillna(v)
    for c in ("c0", "c2", "c3", "c5", "c6", "c8", "t"):
        want = correlation(pdf, c, numbers) if pdf[c].isna().any() else None
        assert held.correlation(c) == (pytest.approx(want, rel=1e-9) if want is not None else None), c


@pytest.mark.parametrize("ps", [(0.25, 0.5, 0.75), (0.01, 0.9)])
def test_quantiles_of_groups_equal_sorting(spark, ps):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", None, None, "é", f"g{i % 40}"]), rng.choice([None, 1.0, 2.5, rng.gauss(0, 9)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = stats.group_quantiles(df, ["k"], F.col("v"), ps)
    assert "percentile" not in got._jdf.queryExecution().toString()
    found = {r.k: r for r in got.collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        x = sorted(v for v in vs if v is not None)
        if not x:
            assert k not in found
            continue
        assert found[k].n == len(x)
        for i, p in enumerate(ps):
            low, high = x[int(np.ceil(len(x) * p)) - 1], x[len(x) - int(np.ceil(len(x) * (1 - p)))]
            assert found[k][f"q{i}"] == pytest.approx((low + high) / 2, rel=1e-12)
    assert stats.group_quantiles(df.where("false"), ["k"], F.col("v"), ps).count() == 0


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 5 else None, float(i % 4), "x" * (i % 2)) for i in range(60)], "row_id long, k string, n double, t string")
    plain = [sorted(map(str, x.collect())) for x in clean.drop_duplicates(df, ["k"])], quality.duplicates(df, ["k", "n", "t"]).first(), quality.duplicates(df, ["k"]).first()
    monkeypatch.setattr(cells, "cell_hashes", lambda df, columns: [F.lit(1), F.lit(2)])
    assert plain == ([sorted(map(str, x.collect())) for x in clean.drop_duplicates(df, ["k"])], quality.duplicates(df, ["k", "n", "t"]).first(), quality.duplicates(df, ["k"]).first())


def test_rows_without_a_number(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "a")], "row_id long, k string")
    assert sorted((r.row_id is None, r.k) for r in clean.drop_duplicates(df, ["k"])[0].collect()) == [(False, "a"), (True, "b"), (True, "c")]
    with pytest.raises(Exception, match="rows must be numbered"):
        clean.drop_duplicates(spark.createDataFrame([(1, "a"), (None, "a")], "row_id long, k string"), ["k"])[0].collect()


OWN = "_n0 _k0 _r0 _n _place _operation _hash1 _number _gone _there _dropped n0 number now".split()


def test_columns_of_the_operators_own_names(spark):
    """Columns that are called as the operators call theirs are data like others."""
    rows = [(i, f"P{i % 40}", *[None if (i + j) % 17 == 0 else float((i * (j + 3)) % 23) for j in range(len(OWN))]) for i in range(100)]
    rows += [(100 + i, *rows[i][1:]) for i in range(5)]
    own = spark.createDataFrame(rows, "row_id long, patient_id string, " + ", ".join(f"`{c}` double" for c in OWN))
    plain = own.toDF("row_id", "patient_id", *[f"x{i}" for i in range(len(OWN))])

    def back(df):
        return df.toDF(*[f"x{OWN.index(c)}" if c in OWN else f"x{OWN.index(c[:-13])}_missing_flag" if c.endswith("_missing_flag") and c[:-13] in OWN else c for c in df.columns])

    def all_of(df):
        marked = clean.mark_all_duplicates(df, ["patient_id"])
        kept, gone = clean.split_duplicates(marked)
        done = pipeline.run(df, AS_OF, keys=("patient_id",))
        name = {c: f"x{i}" for i, c in enumerate(OWN)}
        said = lambda d: sorted(tuple(name.get(v, v) if isinstance(v, str) else v for v in r) for r in d.collect())
        return [
            sorted(map(str, back(kept).orderBy("row_id").collect())), gone.count(), said(profile.profile(df).drop("ordinal")), said(issues.gap_statistics(df, profile.data_columns(df), profile.numeric_columns(df))),
            sorted(map(str, back(clean.flag_duplicates(df, ["patient_id"])).orderBy("row_id").collect())), quality.assess(df, AS_OF).first(), sorted(map(str, back(done.table).orderBy("row_id").collect())), said(done.lineage.select("row_id", "field", "original_value", "new_value").na.fill("")), done.report.first(),
            sorted(map(str, back(lineage.restore(done.table, done.lineage, [c for c in df.columns if c != "row_id"])).orderBy("row_id").collect())), sorted(map(str, back(clean.fix_outliers(df)[0]).orderBy("row_id").collect())),
        ]

    for a, b in zip(all_of(own), all_of(plain), strict=True):
        assert a == b


def test_restored_visits_equal_the_source(spark, sf):
    df = frame(spark, sf, "visits")
    done = pipeline.run(df, AS_OF)
    back = lineage.restore(done.table, done.lineage, profile.data_columns(df))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
