import os

import pytest
from pyspark.sql import functions as F

from tablecare.operators import pipeline
from tablecare.plans.fixtures import AS_OF, frame
from tablecare.sources import files, publish


def test_a_run_shows_all_of_its_files_or_none(spark, sf, tmp_path, monkeypatch):
    df, path = frame(spark, sf, "visits"), str(tmp_path / "out")
    assert publish.published(spark, path) == []
    with pytest.raises(ValueError):
        publish.read(spark, path)

    def dies(*_):
        raise RuntimeError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(publish, "put", dies)
        with pytest.raises(RuntimeError, match="killed"):
            publish.clean(df, path, "a", AS_OF)
    assert publish.published(spark, path) == [] and os.path.isdir(f"{path}/runs/a/table")
    shared = set(os.listdir(_shared(spark)))
    run = publish.clean(df, path, "a", AS_OF, "visits")  # the name is free: nothing was published
    assert {n for n in os.listdir(_shared(spark)) if n.startswith(("fixed", "clean"))} <= shared
    for name, f in run.manifest["files"].items():
        assert run.tables[name].count() == f["rows"], name
    assert run.manifest["operation_count"] == run.manifest["report"]["operation_count"] and run.manifest["decisions"]
    with pytest.raises(ValueError):
        publish.clean(df, path, "a", AS_OF)
    os.makedirs(f"{path}/runs/b/table")
    assert publish.sweep(spark, path) == ["b"] and publish.published(spark, path) == ["a"]
    assert publish.read(spark, path, "a").tables["table"].count() == run.manifest["files"]["table"]["rows"]


def _shared(spark):
    from tablecare.functions.storage import shared_folder

    return shared_folder(spark).removeprefix("file://").removeprefix("file:")


def test_exports_count_without_reading(spark, tmp_path, monkeypatch):
    df = spark.range(10).select(F.col("id").cast("string").alias("field"), (F.col("id") % 2).alias("operation"))
    path = str(tmp_path / "lineage")
    assert files.export(df, path, partition_by="operation") == 10
    with monkeypatch.context() as m:
        m.setattr(type(spark.read), "parquet", lambda *_: pytest.fail("read again"))
        assert files.export(df.limit(3), path, partition_by="operation") == 13
    assert spark.read.parquet(path).count() == 13


def test_a_closed_clean_keeps_its_table(spark, sf):
    done = pipeline.run(frame(spark, sf, "visits"), AS_OF)
    done.close()
    assert done.table.count() == done.rows["table"] and done.lineage.count() == done.rows["lineage"] and done.scratch == []
