"""Request analytics, streams, and the driver's contract."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import service
from graphloom.streaming import streams

import __spark_entry__ as entry


def requests(spark, rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(k, at + dt.timedelta(seconds=s), i) for i, (k, s) in enumerate(rows)], "key string, ts timestamp, n long")


def test_token_bucket(spark):
    rows = [("a", 0), ("a", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 100), ("a", 100), ("a", 100)]
    got = {r["n"]: r["allowed"] for r in service.token_bucket(requests(spark, rows), burst=2, per_minute=60, order="n").collect()}
    assert [got[i] for i in range(8)] == [True, True, False, True, True, True, True, False]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 60, 60, 3000)], "v double")
    h = service.histogram(df, "v")
    row = h.first()
    assert (row["le_50"], row["le_100"], row["le_2500"], row["le_inf"]) == (1, 3, 3, 4)
    assert h.select(service.bucket_percentile(0.5), service.bucket_percentile(0.99)).first()[:2] == (100, 9999)
    assert service.histogram(df.where("v < 0"), "v").select(service.bucket_percentile(0.5)).first()[0] == 0


def test_keys(spark):
    df = spark.createDataFrame([("Bearer k1 ", "k2"), (None, " k2 "), ("Basic x", None)], "a string, x string")
    key = service.extract_key(F.col("a"), F.col("x"))
    assert [tuple(r) for r in df.select(key, service.authorised(key, ["k2"])).collect()] == [("k1", False), ("k2", True), (None, False)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 0), ("a", 0), ("b", 5), ("a", 61)]
    df = requests(spark, rows)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.drain(streams.token_bucket_stream(source, burst=2, per_minute=60), "bucket_test", str(tmp_path / "c1"))
    allowed = sorted((r["key"], r["allowed"]) for r in out.collect())
    want = sorted((r["key"], r["allowed"]) for r in service.token_bucket(df, burst=2, per_minute=60, order="n").collect())
    assert allowed == want
    counts = streams.drain(streams.session_counts(source, key="key", gap="30 seconds"), "session_test", str(tmp_path / "c2"), "complete")
    assert sorted((r["key"], r["n"]) for r in counts.collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_log_stream(spark, tmp_path):
    spark.createDataFrame([("x",), ("y",)], "value string").write.text(str(tmp_path / "in"))
    q = streams.delta_stream(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c"))
    q.awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["x", "y"]


def test_contract(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 80
    assert entry.entry(spark).count() > 0
