"""Streams that are drained into tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import streams


def source(spark, path, rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(k, at + dt.timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp")
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_files(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "parquet" in plan and "MemoryPlan" not in plan and "LocalRelation" not in plan


def test_sessions_are_drained_into_files(spark, tmp_path):
    s = source(spark, str(tmp_path / "in"), [("a", 0), ("a", 10), ("a", 100), ("b", 5), ("b", 6), ("b", 7)])
    out = streams.drain(streams.session_counts(s, key="key", gap="30 seconds"), "sessions_in_files", str(tmp_path / "c"), "complete")
    assert in_files(out)
    assert sorted((r["key"], r["n"]) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_requests_are_drained_into_files(spark, tmp_path):
    s = source(spark, str(tmp_path / "in"), [("a", 0), ("a", 0), ("a", 0), ("b", 5), ("a", 61)])
    out = streams.drain(streams.token_bucket_stream(s, burst=2, per_minute=60), "bucket_in_files", str(tmp_path / "c"))
    assert in_files(out)
    assert sorted((r["key"], r["allowed"]) for r in out.collect()) == [("a", False), ("a", True), ("a", True), ("a", True), ("b", True)]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_without_rows_is_an_empty_table(spark, tmp_path, mode):
    df = spark.range(0).select(F.col("id").cast("string").alias("key"), F.current_timestamp().alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.drain(s if mode == "append" else s.groupBy("key").count(), f"empty_{mode}", str(tmp_path / "c"), mode)
    assert out.count() == 0 and "key" in out.columns
