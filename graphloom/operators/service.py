"""Analytics of a service's requests: rate limits, keys, latencies and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in milliseconds, and what a percentile beyond them is.
BOUNDS = (50, 100, 250, 500, 1000, 2500)
BEYOND = 9999


def token_bucket(requests: DataFrame, key: str = "key", at: str = "ts", burst: int = 20, per_minute: float = 60.0, order: str | None = None) -> DataFrame:
    """Each request with ``allowed``: a key's bucket starts full, refills by elapsed time, and a request takes one token.

    A decision depends on all earlier ones of its key, so each key's requests are folded over in order of time (and
    ``order`` for equal times) as one array. A key is idle between two bursts anyway: its requests are split into sessions
    wherever the bucket is certain to be full again, after burst / rate seconds, so that an array holds one session only.
    """
    rate = per_minute / 60.0
    tie = order or at
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)
    w = Window.partitionBy(key).orderBy(at, tie)
    r = requests.withColumn("_s", seconds).withColumn("_gap", F.col("_s") - F.lag("_s").over(w))
    r = r.withColumn("_session", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") * rate >= burst), 1).otherwise(0)).over(w))
    row = F.struct(F.col("_s").alias("s"), F.col(tie).alias("tie"), F.struct(*requests.columns).alias("row"))
    folded = r.groupBy(key, "_session").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    state = f"named_struct('tokens', CAST({burst} AS double), 'last', rows[0].s, 'out', CAST(array() AS array<boolean>))"
    filled = f"least(a.tokens + (x.s - a.last) * {rate}D, {burst}D)"
    step = f"named_struct('tokens', IF({filled} >= 1, {filled} - 1, {filled}), 'last', x.s, 'out', concat(a.out, array({filled} >= 1)))"
    folded = folded.withColumn("allowed", F.expr(f"aggregate(rows, {state}, (a, x) -> {step}, a -> a.out)"))
    return folded.select(F.explode(F.arrays_zip("rows", "allowed")).alias("z")).select("z.rows.row.*", "z.allowed")


def extract_key(authorization: Column, x_api_key: Column) -> Column:
    """A request's key: that of a Bearer header before that of X-API-Key, trimmed."""
    bearer = F.when(authorization.startswith("Bearer "), F.trim(F.substring(authorization, 8, 1 << 30)))
    return F.coalesce(bearer, F.trim(x_api_key))


def authorised(key: Column, keys: list[str]) -> Column:
    """Whether a key is among the known ones; all are if none is set."""
    return F.coalesce(key.isin(keys), F.lit(False)) if keys else F.lit(True)


def client_key(forwarded_for: Column, peer: Column) -> Column:
    """Who a public request is counted for: the first forwarded address, else the peer."""
    first = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), peer)


def histogram(df: DataFrame, column: str, by: list[str] | None = None, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts by bound, ``le_<bound>`` and ``le_inf``, with sum and count, in one aggregation."""
    v = F.col(column)
    within = [F.coalesce(F.sum(F.when(v <= b, 1).otherwise(0)), F.lit(0)).alias(f"le_{b}") for b in bounds]
    return df.groupBy(*(by or [])).agg(*within, F.count(v).alias("le_inf"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"))


def bucket_percentile(p: float, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """The first bound of a histogram row that holds the p-th part of the values; 0 of none, BEYOND above all bounds."""
    need = F.ceil(F.col("n") * F.lit(p))
    found = F.coalesce(*[F.when(F.col(f"le_{b}") >= need, b) for b in bounds], F.lit(BEYOND))
    return F.when(F.col("n") == 0, 0).otherwise(found).cast("long")


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of hits as text, ``12.3%``."""
    total = hits + misses
    return F.format_string("%.1f%%", F.when(total > 0, hits / total * 100).otherwise(0.0))


def load_stats(df: DataFrame, latency: str, failed: Column, seconds: Column) -> DataFrame:
    """One row of a load test: requests, errors, error rate, rate, mean, deviation and percentiles of the latencies."""
    v = F.col(latency)
    out = df.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(failed, 1).otherwise(0)).alias("errors"),
        F.avg(v).alias("mean_ms"),
        F.stddev_samp(v).alias("stdev_ms"),
        *[F.percentile(v, p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)],
        (F.max(seconds) - F.min(seconds)).alias("span_s"),
    )
    return out.withColumn("error_rate", F.col("errors") / F.col("requests")).withColumn("qps", F.when(F.col("span_s") > 0, F.col("requests") / F.col("span_s")).otherwise(0.0))


def memory_profile(df: DataFrame, at: str, value: str) -> DataFrame:
    """One row of a memory profile: least, most, first, last, and growth between those."""
    v = F.col(value)
    out = df.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return out.withColumn("growth", F.col("last") - F.col("first"))


#: Names and help texts of the counters and gauges.
COUNTERS = {
    "queries_total": "Total query requests",
    "queries_failed_total": "Failed queries",
    "cache_hits_total": "LRU cache hits",
    "cache_misses_total": "LRU cache misses",
    "ingest_total": "Total ingest requests",
    "ingest_failed_total": "Failed ingest requests",
    "nodes_ingested_total": "Total new nodes committed to delta",
}
GAUGES = {"delta_size": "Current delta buffer size", "graph_nodes": "Total nodes in main graph", "graph_edges": "Total edges in main graph"}


def exposition(metric: Column, kind: Column, help_text: Column, value: Column) -> Column:
    """A metric in the text format of a metrics endpoint."""
    return F.concat(F.lit("# HELP "), metric, F.lit(" "), help_text, F.lit("\n# TYPE "), metric, F.lit(" "), kind, F.lit("\n"), metric, F.lit(" "), value.cast("string"))


def histogram_lines(name: str, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """A histogram row in that format."""
    rows = [F.concat(F.lit(f'{name}_bucket{{le="{b}"}} '), F.col(f"le_{b}").cast("string")) for b in bounds]
    rows.append(F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), F.col("le_inf").cast("string")))
    rows.append(F.concat(F.lit(f"{name}_sum "), F.col("total").cast("long").cast("string")))
    rows.append(F.concat(F.lit(f"{name}_count "), F.col("n").cast("string")))
    return F.concat_ws("\n", *rows)
