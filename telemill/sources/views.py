"""Typed telemetry views over the test tables, each with the SQL that defines the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.columns import first_filled, non_blank, unix_seconds
from telemill.schema import DURATION_BOUNDS
from telemill.session import table


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts (event time, else arrival), service, level, user, endpoint, operation, latency_ms."""
    return table(spark, sf_dir, "log_events").select(
        "log_id", F.coalesce(unix_seconds(F.col("event_ts")), F.col("ts_unix")).alias("ts"), F.coalesce(non_blank(F.col("service")), F.lit("unknown")).alias("service"),
        "level", first_filled(F.col("user_id"), F.col("account_id")).alias("user"), "endpoint", "operation", "latency_ms",
    )


LOGS_SQL = """logs AS (
  SELECT log_id, CASE WHEN event_ts IS NULL THEN ts_unix ELSE epoch_us(event_ts) // 1000000 END AS ts,
         coalesce(nullif(service, ''), 'unknown') AS service, level,
         coalesce(nullif(user_id, ''), nullif(account_id, '')) AS "user", endpoint, operation, latency_ms
  FROM log_events)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource_spans: every event as a nested request with one span of value / 100 seconds."""
    e = table(spark, sf_dir, "events")
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) * 1000
    failed = F.col("event_type") == "error"
    exception = F.struct(F.lit("Exception").alias("name"), F.create_map(F.lit("exception.type"), F.concat(F.lit("E"), F.col("event_id") % 3)).alias("attributes"))
    empty = F.array().cast("array<struct<name:string,attributes:map<string,string>>>")
    span = F.struct(
        (1 + F.col("event_id") % 5).cast("int").alias("kind"), start.alias("start_time_unix_nano"), (start + F.round(F.col("value") * 10_000_000).cast("long")).alias("end_time_unix_nano"),
        F.create_map(F.lit("http.route"), F.col("event_type")).alias("attributes"), F.struct(F.when(failed, 2).otherwise(0).alias("code")).alias("status"),
        F.when(failed & (F.col("event_id") % 2 == 0), F.array(exception)).otherwise(empty).alias("events"),
    )
    resource = F.struct(F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), F.col("user_id") % 5)).alias("attributes"))
    return e.select(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scope_spans"))).alias("resource_spans"))


SPANS_SQL = """spans AS (
  SELECT event_id, 'svc-' || (user_id % 5) AS service, event_type AS route, (1 + event_id % 5)::INT AS kind,
         CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS status_code, epoch_us(ts) * 1000 AS start_ns,
         epoch_us(ts) * 1000 + round(value * 10000000)::BIGINT AS end_ns,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'E' || (event_id % 3) END AS exception
  FROM events)"""


def prom_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels, value, ts_ms: line items as remote-write samples of three metrics."""
    item = table(spark, sf_dir, "lineitem")
    which = F.col("l_linenumber") % 3
    name = F.when(which == 0, "http_duration_seconds_bucket").when(which == 1, "http_requests_total").otherwise("http_errors_total")
    bounds = F.lit(list(DURATION_BOUNDS))
    le = F.try_element_at(F.filter(bounds, lambda b: b >= F.col("l_discount")), F.lit(1)).cast("string")
    labels = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in ("__name__", "job", "status_code", "le")]), F.array(name, F.col("l_returnflag"), F.when(which == 1, F.when(F.col("l_linestatus") == "O", "200").otherwise("500")), F.when(which == 0, le))),
        lambda k, v: v.isNotNull(),
    )
    return item.select(labels.alias("labels"), F.col("l_quantity").alias("value"), (unix_seconds(F.col("l_shipdate")) * 1000).alias("ts_ms"))


def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative points with resets: running counts modulo 50 per service and event type, total and by value bucket."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("service", F.concat(F.lit("svc-"), F.col("user_id") % 5))
    w = Window.partitionBy("service", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    at = F.when(F.col("value") <= 50, 0).when(F.col("value") <= 150, 1).otherwise(2)
    counts = F.array(*[(F.count(F.when(at == i, 1)).over(w) % 50).cast("long") for i in range(3)])
    return e.select(
        "event_id", F.create_map(F.lit("service.name"), F.col("service")).alias("resource"), F.lit("hits").alias("name"), F.lit("sum").alias("kind"), F.lit(2).alias("temporality"),
        F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), (F.count(F.lit(1)).over(w) % 50).cast("double").alias("value"), F.lit([50.0, 150.0]).alias("bounds"), counts.alias("counts"),
        (us * 1000 + F.col("event_id") % 1000).alias("time_unix_nano"),
    )


COUNTERS_SQL = """counters AS (
  SELECT event_id, service, event_type, epoch_us(ts) * 1000 + event_id % 1000 AS t, (count(*) OVER w % 50)::DOUBLE AS v,
         count(*) FILTER (value <= 50) OVER w % 50 AS b0, count(*) FILTER (value > 50 AND value <= 150) OVER w % 50 AS b1,
         count(*) FILTER (value > 150) OVER w % 50 AS b2
  FROM (SELECT *, 'svc-' || (user_id % 5) AS service FROM events)
  WINDOW w AS (PARTITION BY service, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

def otlp_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OTLP log records with any-typed bags in JSON text."""
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    bag = F.concat(F.lit('{"service.name":"svc-'), F.col("user_id") % 5, F.lit('","shard":'), F.col("user_id") % 7, F.lit(',"ratio":1.25,"ready":true,"list":[1,2]}'))
    return e.select(
        "event_id", bag.alias("resource"), F.lit("app").alias("scope_name"), F.lit("").alias("scope_version"), (us * 1000).alias("time_unix_nano"), F.lit(0).cast("long").alias("observed_unix_nano"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity_text"), F.when(F.col("event_type") == "error", 17).otherwise(9).alias("severity_number"),
        F.col("event_type").alias("body"), F.to_binary(F.lpad(F.hex("event_id"), 32, "0"), F.lit("hex")).alias("trace_id"), F.lit(b"").alias("span_id"), F.lit(0).alias("flags"), F.col("props").alias("attributes"),
    )
