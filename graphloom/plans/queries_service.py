"""Analytics of requests, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import service
from graphloom.plans.graphs import table
from graphloom.plans.registered import query
from graphloom.session import checkpoint_dir
from graphloom.streaming import streams

LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in service.BOUNDS)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT event_type, {LE}, count(*) AS le_inf, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY event_type")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = service.histogram(_events(spark, d), "value", ["event_type"])
    return h.withColumn("total", F.round("total", 3))


def _percentile(p: float) -> str:
    return "CASE WHEN n = 0 THEN 0 " + " ".join(f"WHEN le_{b} >= ceil(n * {p}) THEN {b}" for b in service.BOUNDS) + f" ELSE {service.BEYOND} END::BIGINT"


@query(f"WITH h AS (SELECT event_type, {LE}, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, {_percentile(0.5)} AS p50, {_percentile(0.95)} AS p95, {_percentile(0.99)} AS p99 FROM h")
def bucket_percentiles(spark: SparkSession, d: str) -> DataFrame:
    h = service.histogram(_events(spark, d), "value", ["event_type"])
    return h.select("event_type", *[service.bucket_percentile(p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query("SELECT event_type, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE value <= 50) / count(*)) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    c = _events(spark, d).groupBy("event_type").agg(F.sum(F.when(F.col("value") <= 50, 1).otherwise(0)).alias("h"), F.count(F.lit(1)).alias("n"))
    return c.select("event_type", service.hit_rate(F.col("h"), F.col("n") - F.col("h")).alias("hit_rate"))


#: Two requests at once, then one each ten hours, for each user: each key's requests folded in order of time.
BUCKET_SQL = """WITH r AS (SELECT user_id, list({'s': epoch_us(ts) / 1e6, 'id': event_id} ORDER BY ts, event_id) AS rows FROM events GROUP BY user_id),
f AS (SELECT user_id, rows, list_reduce(list_prepend({'tokens': 2.0::DOUBLE, 'last': rows[1].s, 'out': []::BOOLEAN[]}, list_transform(rows, lambda x: {'tokens': 0.0::DOUBLE, 'last': x.s, 'out': []::BOOLEAN[]})),
   lambda a, x: {'tokens': CASE WHEN least(a.tokens + (x.last - a.last) * (1.0 / 36000), 2.0) >= 1 THEN least(a.tokens + (x.last - a.last) * (1.0 / 36000), 2.0) - 1 ELSE least(a.tokens + (x.last - a.last) * (1.0 / 36000), 2.0) END,
                 'last': x.last, 'out': a.out || [least(a.tokens + (x.last - a.last) * (1.0 / 36000), 2.0) >= 1]}).out AS out FROM r)
SELECT user_id, unnest(list_transform(rows, lambda x: x.id)) AS event_id, unnest(out) AS allowed FROM f"""


@query(BUCKET_SQL)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "ts")
    return service.token_bucket(e, "user_id", "ts", burst=2, per_minute=60 / 36000, order="event_id").select("user_id", "event_id", "allowed")


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' || (event_id % 5) WHEN event_id % 3 = 1 THEN 'k' || (event_id % 7) END AS key FROM events)
    SELECT event_id, key, coalesce(key IN ('k1', 'k2'), false) AS allowed FROM k""")
def auth_filter(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    bearer = F.when(i % 3 == 0, F.concat(F.lit("Bearer  k"), (i % 5).cast("string"), F.lit(" ")))
    header = F.when(i % 3 < 2, F.concat(F.lit("k"), (i % 7).cast("string")))
    e = _events(spark, d).select("event_id", service.extract_key(bearer, header).alias("key"))
    return e.withColumn("allowed", service.authorised(F.col("key"), ["k1", "k2"]))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 9) ELSE 'peer' END AS client FROM events")
def public_client_key(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    forwarded = F.when(i % 2 == 0, F.concat(F.lit(" 10.0.0."), (i % 9).cast("string"), F.lit(", 10.1.1.1")))
    return _events(spark, d).select("event_id", service.client_key(forwarded, F.lit("peer")).alias("client"))


@query("""WITH s AS (SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, avg(value) AS mean_ms, stddev_samp(value) AS stdev_ms, quantile_cont(value, 0.5) AS p50_ms,
    quantile_cont(value, 0.95) AS p95_ms, quantile_cont(value, 0.99) AS p99_ms, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_s FROM events)
    SELECT requests, errors, round(mean_ms, 4) AS mean_ms, round(stdev_ms, 4) AS stdev_ms, round(p50_ms, 4) AS p50_ms, round(p95_ms, 4) AS p95_ms, round(p99_ms, 4) AS p99_ms,
    round(errors / requests, 6) AS error_rate, round(requests / span_s, 6) AS qps FROM s""")
def loadtest_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    s = service.load_stats(e, "value", F.col("event_type") == "error", F.unix_micros("ts") / F.lit(1e6))
    return s.select("requests", "errors", *[F.round(c, 4).alias(c) for c in ("mean_ms", "stdev_ms", "p50_ms", "p95_ms", "p99_ms")], F.round("error_rate", 6).alias("error_rate"), F.round("qps", 6).alias("qps"))


@query("SELECT min(value) AS least, max(value) AS most, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS growth FROM events")
def memory_profile(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return service.memory_profile(e, "at", "value").withColumn("growth", F.round("growth", 6))


@query("SELECT 'queries_total' AS metric, '# HELP queries_total Total query requests' || chr(10) || '# TYPE queries_total counter' || chr(10) || 'queries_total ' || count(*) AS text FROM events")
def metrics_exposition(spark: SparkSession, d: str) -> DataFrame:
    n = _events(spark, d).agg(F.count(F.lit(1)).alias("n"))
    name = "queries_total"
    return n.select(F.lit(name).alias("metric"), service.exposition(F.lit(name), F.lit("counter"), F.lit(service.COUNTERS[name]), F.col("n")).alias("text"))


H_SQL = "SELECT " + " || chr(10) || ".join([f"'query_latency_ms_bucket{{le=\"{b}\"}} ' || count(*) FILTER (WHERE value <= {b})" for b in service.BOUNDS] + ["'query_latency_ms_bucket{le=\"+Inf\"} ' || count(*)", "'query_latency_ms_sum ' || floor(sum(value))::BIGINT", "'query_latency_ms_count ' || count(*)"]) + " AS text FROM events"


@query(H_SQL)
def histogram_exposition(spark: SparkSession, d: str) -> DataFrame:
    h = service.histogram(_events(spark, d), "value")
    return h.select(service.histogram_lines("query_latency_ms").alias("text"))


# ---- streams: everything that is there, through a streaming plan -------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    name = f"drained_{uuid.uuid4().hex}"
    return streams.drain(df, name, f"{checkpoint_dir(spark)}/{name}", mode)


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, {LE} FROM events GROUP BY 1, 2")
def stream_window_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, streams.window_metrics(_stream(spark, d)), "complete")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_delta_counts(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, _stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, streams.session_counts(_stream(spark, d)), "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query()
def stream_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    out = streams.token_bucket_stream(_stream(spark, d), "user_id", "ts", burst=2, per_minute=60 / 36000)
    return _drained(spark, out, "append")
