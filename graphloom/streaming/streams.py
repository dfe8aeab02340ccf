"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.service import BOUNDS


def window_metrics(events: DataFrame, at: str = "ts", value: str = "value", window: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(window_start, key, n, total, le_<bound>...) of tumbling windows; rows later than ``late`` are dropped."""
    v = F.col(value)
    w = F.window(F.col(at), window)
    counts = [F.sum(F.when(v <= b, 1).otherwise(0)).alias(f"le_{b}") for b in BOUNDS]
    out = events.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), *counts)
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total", *[f"le_{b}" for b in BOUNDS])


def session_counts(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, key, n) of each key's sessions, which end after a gap."""
    out = events.withWatermark(at, late).groupBy(F.session_window(F.col(at), gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def delta_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of log lines to a log folder, each micro-batch once."""
    return records.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


STATE, IDLE_MS = "tokens double, last double", 600_000


def token_bucket_stream(requests: DataFrame, key: str = "key", at: str = "ts", burst: int = 20, per_minute: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """(key, s, allowed) of a stream of requests, s being seconds; a key's bucket is state, dropped once event time is ten
    idle minutes further and the bucket must be full again. Rows later than ``late`` are dropped."""
    rate = per_minute / 60.0
    idle = max(IDLE_MS, int(1000 * burst / rate) + 1)

    def check(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(parts)).sort_values("s", kind="stable")
        allowed = []
        for s in rows["s"]:
            tokens = min(float(burst), tokens + max(0.0, s - (s if last is None else last)) * rate)
            last = s
            allowed.append(tokens >= 1)
            tokens -= 1.0 if tokens >= 1 else 0.0
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": str(k[0]), "s": rows["s"].to_numpy(), "allowed": allowed})

    timed = requests.withWatermark(at, late)
    asked = timed.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)).alias("s"), F.col(at))
    return asked.groupBy("key").applyInPandasWithState(check, "key string, s double, allowed boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files beside its checkpoint, and return the table they are.

    Each micro-batch is written by the executors under its own number, so that one that is repeated replaces itself. In append
    mode the table is all of them; in complete mode, where each has all rows, it is the last.
    """
    spark: SparkSession = df.sparkSession
    rows, written = f"{checkpoint.rstrip('/')}/rows/{name}", set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{number}")
        written.add(number)

    q = df.writeStream.queryName(name).foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{rows}/{n}" for n in (sorted(written) if mode == "append" else [max(written)])])
