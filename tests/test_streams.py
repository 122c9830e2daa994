import os

import pytest
from pyspark.sql import functions as F

from tablecare.streaming import events, store

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture
def base(spark):
    rows = [(i, None if i % 11 == 0 else i % 5, ["view", "error", "purchase"][i % 3]) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string").select("event_id", F.timestamp_seconds(F.col("event_id") * 977 % 40_000 + 1_700_000_000).alias("ts"), "user_id", "event_type")


def put(df, folder, low, high):
    df.where(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").parquet(str(folder))


def same(a, b):
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_replay_then_follow_gives_each_event_once(spark, base, tmp_path):
    for low, high in ((0, 40), (30, 70), (60, 61)):  # files that overlap
        put(base, tmp_path / "in", low, high)
    stream = lambda: store.once(events.follow(spark, str(tmp_path / "in"), base.schema, files_a_batch=1))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sink, failed = store.history_sink(out), []

    def killed(batch, number):
        sink(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("killed between write and commit")

    with pytest.raises(Exception, match="killed"):
        store.run(stream(), killed, state).awaitTermination()
    store.run(stream(), killed, state).awaitTermination()
    same(store.history(spark, out, base.schema), base.where("event_id <= 70"))
    put(base, tmp_path / "in", 65, 119)
    query = store.run(stream(), sink, state, available_now=False)
    query.processAllAvailable()
    put(base, tmp_path / "in", 100, 119)
    query.processAllAvailable()
    query.stop()
    same(store.history(spark, out, base.schema), base)
    before = {f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")}
    assert store.purge(spark, out, base.schema, 1) == base.where("user_id = 1").count()
    same(store.history(spark, out, base.schema), events.purge(base, 1))
    assert events.purge(base, 1).where("user_id IS NULL").count() == base.where("user_id IS NULL").count() > 0
    touched = store._bucket_of(spark, 1, base.schema)
    after = {f: d for d, _, names in os.walk(out) for f in names if f.endswith(".parquet")}
    assert all(d.endswith(f"bucket={touched}") for f, d in after.items() if f not in before) and len(before & set(after)) > len(before) / 2
    assert store.purge(spark, out, base.schema, None) == base.where("user_id IS NULL").count()
    same(store.history(spark, out, base.schema), base.where("user_id != 1"))
    assert store.purge(spark, out, base.schema, 77) == 0


def test_retained_events_equal_the_batch_answer_after_each_batch_and_a_restart(spark, base, tmp_path):
    for low, high in ((0, 30), (31, 75), (76, 119)):
        put(base, tmp_path / "in", low, high)
        stream = events.follow(spark, str(tmp_path / "in"), base.schema)
        store.retain(stream, 4, str(tmp_path / "kept"), str(tmp_path / "state")).awaitTermination()  # a new query each time
        same(store.kept(spark, str(tmp_path / "kept"), base.schema), events.retain_each(base.where(F.col("event_id") <= high), 4))


def test_job_listing_by_upserts(spark, base, tmp_path):
    for low, high in ((0, 3), (4, 75), (76, 119)):
        put(base, tmp_path / "in", low, high)
        stream = events.follow(spark, str(tmp_path / "in"), base.schema, files_a_batch=1)
        store.follow_jobs(stream, str(tmp_path / "jobs"), str(tmp_path / "state")).awaitTermination()
        want = events.jobs(base.where(F.col("event_id") <= high))
        same(store.listing(spark, str(tmp_path / "jobs"), want.schema), want)
