"""Windowed aggregates on streams: event time, watermark, append mode.

The same formulas as the batch operators, with the distinct users as a set (an
exact distinct count isn't allowed on streams) and top-k by two chained windowed
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.columns import non_blank, percentiles
from telemill.operators.logs import is_error


def event_timestamp(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def _timed(logs: DataFrame, lateness: str) -> DataFrame:
    return logs.withColumn("service", F.coalesce(non_blank(F.col("service")), F.lit("unknown"))).withColumn("at", event_timestamp(F.col("ts"))).withWatermark("at", lateness)


def log_totals(logs: DataFrame, seconds: int, lateness: str, value: str = "latency_ms", user: str = "user") -> DataFrame:
    """service, window_start, window_end, count, rps, error_rate, p50, p95, p99, unique_users of closed windows."""
    p50, p95, p99 = percentiles(F.col(value), (0.5, 0.95, 0.99))
    agg = _timed(logs, lateness).groupBy(F.window("at", f"{seconds} seconds").alias("w"), "service").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_error(F.col("level"))).alias("errors"), p50.alias("p50"), p95.alias("p95"), p99.alias("p99"), F.size(F.collect_set(non_blank(F.col(user)))).cast("long").alias("unique_users")
    )
    return agg.select(
        "service", F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "count", (F.col("count") / F.lit(float(seconds))).alias("rps"),
        (F.col("errors") / F.col("count")).alias("error_rate"), "p50", "p95", "p99", "unique_users",
    )


def top_k(logs: DataFrame, seconds: int, lateness: str, field: str, limit: int = 5) -> DataFrame:
    """service, window_start, top of closed windows."""
    counted = _timed(logs, lateness).where(non_blank(F.col(field)).isNotNull()).groupBy(F.window("at", f"{seconds} seconds").alias("w"), "service", F.col(field).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    again = counted.groupBy(F.window("w", f"{seconds} seconds").alias("w2"), "service").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "v"))).alias("all"))
    text = F.array_join(F.transform(F.slice("all", 1, limit), lambda x: F.concat_ws(":", x["v"], (-x["k"]).cast("string"))), ",")
    return again.select("service", F.unix_seconds("w2.start").alias("window_start"), text.alias("top"))


def insert_once(rows: DataFrame, id_col: str, at: str, lateness: str) -> DataFrame:
    """Each id once, as first seen within the watermark."""
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([id_col])


def late_corrections(records: DataFrame, seconds: int, cutoff: str) -> DataFrame:
    """Counts per service and event window in update mode: every late record within the cut-off gives a corrected row."""
    timed = records.withColumn("at", event_timestamp(F.col("event"))).withWatermark("at", cutoff)
    agg = timed.groupBy(F.window("at", f"{seconds} seconds").alias("w"), "service").agg(F.count(F.lit(1)).alias("records"))
    return agg.select("service", F.unix_seconds("w.start").alias("window_start"), "records")
