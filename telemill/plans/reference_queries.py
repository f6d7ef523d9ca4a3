"""One query per operator of the telemetry engine, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.filters.expressions import filter_aggregates, filter_envelopes
from telemill.functions.columns import window_start
from telemill.functions.percentiles import group_percentiles
from telemill.operators import forest, logs, metrics, otlp_logs, series, spans, vectors
from telemill.schema import DURATION_BOUNDS
from telemill.sinks import stores
from telemill.sources import brokers, codecs, landing, otlp, views
from telemill.session import ensure_checkpoint_dir, table

DAY = 86_400
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Logs

_LOGSUM_SQL = f"""WITH {views.LOGS_SQL}
SELECT service, ts - ts % {DAY} AS window_start, ts - ts % {DAY} + {DAY} AS window_end, count(*) AS count,
       round(count(*) / {DAY}.0, 6) AS rps, round(avg((lower(coalesce(level, '')) IN ('error', 'fatal'))::INT), 6) AS error_rate,
       round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95,
       round(coalesce(quantile_cont(latency_ms, 0.99), 0), 6) AS p99, count(DISTINCT "user") AS unique_users
FROM logs GROUP BY ALL"""


@query(_LOGSUM_SQL)
def logsum_daily(spark: SparkSession, d: str) -> DataFrame:
    return _round(logs.totals(views.logs(spark, d), DAY), 6, "rps", "error_rate", "p50", "p95", "p99")


@query(f"WITH {views.LOGS_SQL} SELECT log_id, ts, ts - ts % 60 AS window_start, ts - ts % 60 + 60 AS window_end FROM logs")
def a1_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    start = window_start(F.col("ts"), 60)
    return views.logs(spark, d).select("log_id", "ts", start.alias("window_start"), (start + 60).alias("window_end"))


@query(f"WITH {views.LOGS_SQL} SELECT service, ts - ts % 3600 AS window_start, count(*) AS total, count(*) FILTER (lower(level) IN ('error', 'fatal')) AS errors FROM logs GROUP BY ALL")
def a12_log_totals(spark: SparkSession, d: str) -> DataFrame:
    return logs.windowed(views.logs(spark, d), 3600).groupBy("service", "window_start").agg(F.count(F.lit(1)).alias("total"), F.count_if(logs.is_error(F.col("level"))).alias("errors"))


def _topk_sql(field: str) -> str:
    return f"""WITH {views.LOGS_SQL}, n AS (SELECT service, ts - ts % {DAY} AS window_start, {field} AS v, count(*) AS n FROM logs WHERE {field} IS NOT NULL AND {field} <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY service, window_start ORDER BY n DESC, v) AS k FROM n)
SELECT service, window_start, string_agg(v || ':' || n, ',' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY ALL"""


@query(_topk_sql("endpoint"))
def a13_topk_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_k(views.logs(spark, d), DAY, "endpoint")


@query(_topk_sql("operation"))
def a13_topk_operation(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_k(views.logs(spark, d), DAY, "operation")


@query(f'WITH {views.LOGS_SQL} SELECT service, ts - ts % 3600 AS window_start, count(DISTINCT "user") AS unique_users FROM logs GROUP BY ALL')
def a14_unique_users(spark: SparkSession, d: str) -> DataFrame:
    return logs.totals(views.logs(spark, d), 3600).select("service", "window_start", "unique_users")


@query(f"WITH {views.LOGS_SQL} SELECT operation, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM logs WHERE latency_ms IS NOT NULL GROUP BY ALL")
def a16_log_percentiles(spark: SparkSession, d: str) -> DataFrame:
    counted = views.logs(spark, d).where("latency_ms IS NOT NULL").groupBy("operation", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    return _round(group_percentiles(counted, ["operation"], "latency_ms", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), 6, "p50", "p95", "p99")


@query(
    f"""WITH {views.LOGS_SQL}, t AS (SELECT service, ts - ts % {DAY} AS window_start, count(*) AS n, avg((lower(coalesce(level, '')) IN ('error', 'fatal'))::INT) AS e, count(DISTINCT "user") AS u FROM logs GROUP BY ALL),
n AS (SELECT service, ts - ts % {DAY} AS window_start, operation AS v, count(*) AS n FROM logs WHERE operation IS NOT NULL AND operation <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY service, window_start ORDER BY n DESC, v) AS k FROM n),
top AS (SELECT service, window_start, string_agg(v || ':' || n, ',' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY ALL)
SELECT service, window_start, 'logs summary: service=' || service || ' total=' || n || ' error_rate=' || printf('%.4f', round(e, 4)) || coalesce(' top_operation=' || top, '') AS summary,
       top AS top_operation, CASE WHEN u > 0 THEN u::VARCHAR END AS unique_users
FROM t LEFT JOIN top USING (service, window_start)"""
)
def a19_log_summary_text(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.summarize(views.logs(spark, d), DAY, ["operation"])
    return rows.select("service", "window_start", "summary", F.col("labels")["top_operation"].alias("top_operation"), F.col("labels")["unique_users"].alias("unique_users"))


_JSON = "j AS (SELECT feed, file_no, line_no, try_cast(raw AS JSON) AS j FROM raw_logs WHERE starts_with(trim(raw), '{')), o AS (SELECT * FROM j WHERE json_type(j) = 'OBJECT')"


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_logs").select("feed", "file_no", "line_no", logs.parse_object(F.col("raw")).alias("v")).where("v IS NOT NULL")


def _sql_scalar(key: str) -> str:
    return f"""CASE WHEN json_type(j->'$."{key}"') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN j->>'$."{key}"' END"""


@query(f"WITH {_JSON} SELECT feed, file_no, line_no, coalesce(nullif(coalesce({', '.join(_sql_scalar(k) for k in ('service', *logs.SERVICE_KEYS))}), ''), 'unknown') AS service FROM o")
def p9c_service_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _json_lines(spark, d).select("feed", "file_no", "line_no", logs.service_of(F.col("v")).alias("service"))


@query(
    f"""WITH {_JSON} SELECT feed, file_no, line_no, lower({_sql_scalar('level')}) AS level,
coalesce(lower({_sql_scalar('level')}) IN ('error', 'fatal'), false) AS is_error,
CASE WHEN json_type(j->'latency_ms') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN try_cast(j->>'latency_ms' AS DOUBLE) END AS latency_ms,
coalesce(nullif({_sql_scalar('user_id')}, ''), nullif({_sql_scalar('userId')}, ''), nullif({_sql_scalar('uid')}, '')) AS "user" FROM o"""
)
def d5_json_fields(spark: SparkSession, d: str) -> DataFrame:
    level = F.lower(logs.first_field(F.col("v"), ["level"]))
    return _json_lines(spark, d).select("feed", "file_no", "line_no", level.alias("level"), logs.is_error(level).alias("is_error"), logs.numeric_field(F.col("v"), "latency_ms").alias("latency_ms"), logs.first_field(F.col("v"), ["user_id", "userId", "uid"]).alias("user"))


@query(
    """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)) AS line FROM x) SELECT doc_id, line_no::BIGINT AS line_no, length(line) AS n, md5(line) AS h FROM y WHERE line <> ''"""
)
def s10_ndjson_split(spark: SparkSession, d: str) -> DataFrame:
    lines = landing.split_lines(table(spark, d, "documents").select("doc_id", "text"), "text")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"), F.md5("line").alias("h"))


# Envelopes


@query("SELECT envelope_id, octet_length(bytes) AS n FROM envelopes WHERE octet_length(bytes) <= 160")
def s12_size_bound(spark: SparkSession, d: str) -> DataFrame:
    return landing.within_size(table(spark, d, "envelopes"), "bytes", 160).select("envelope_id", F.octet_length("bytes").cast("long").alias("n"))


@query("SELECT envelope_id, attrs['env'] AS env, attrs['topic'] AS topic FROM envelopes")
def s13_metadata_attrs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "envelopes")
    secret = F.array(F.struct(F.lit("Authorization").alias("key"), F.lit("x").cast("binary").alias("value")))
    headers = F.concat(secret, F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda x: F.struct(x["key"].alias("key"), x["value"].cast("binary").alias("value"))))
    a = landing.attributes(headers)
    return e.select("envelope_id", a["env"].alias("env"), a["topic"].alias("topic"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'json_logs' WHEN 'view' THEN 'prom_rw' WHEN 'error' THEN 'traces' ELSE 'metrics' END AS kind FROM events""")
def s14_kind_normalised(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("event_type") == "click", " JSON ").when(F.col("event_type") == "view", "PromRemoteWrite").when(F.col("event_type") == "error", "Traces").otherwise("other")
    return table(spark, d, "events").select("event_id", landing.normal_kind(spelled).alias("kind"))


@query("SELECT event_id AS id, 'events' AS origin FROM events UNION ALL SELECT envelope_id, 'envelopes' FROM envelopes")
def s17_fan_in(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("origin"))
    return landing.fan_in(a, table(spark, d, "envelopes").select(F.lit("envelopes").alias("origin"), F.col("envelope_id").alias("id")))


@query("SELECT kind, kind IN ('metrics', 'prom_rw') AS summarised, count(*) AS n FROM envelopes GROUP BY ALL")
def p16_kind_router(spark: SparkSession, d: str) -> DataFrame:
    mine, rest = landing.route(table(spark, d, "envelopes"), "metrics", "prom_rw")
    return landing.fan_in(mine.withColumn("summarised", F.lit(True)), rest.withColumn("summarised", F.lit(False))).groupBy("kind", "summarised").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT envelope_id, octet_length(bytes) AS n, md5(decode(bytes)) AS h FROM envelopes WHERE kind = 'json_logs'")
def s8_gzip_decode(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d, "gzip")


@query("SELECT envelope_id, octet_length(bytes) * 2 AS n, md5(decode(bytes) || decode(bytes)) AS h FROM envelopes WHERE kind = 'json_logs'")
def s9_snappy_decode(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d, "snappy")


def _decoded(spark: SparkSession, d: str, encoding: str) -> DataFrame:
    e = table(spark, d, "envelopes").where("kind = 'json_logs'")
    if encoding == "snappy":  # every body twice, so that blocks hold copies
        e = e.withColumn("bytes", F.concat("bytes", "bytes"))
    body = codecs.decode_body(F.col("packed"), F.lit(encoding))
    return e.withColumn("packed", codecs.encode_body(F.col("bytes"), encoding)).select("envelope_id", body.alias("b")).select("envelope_id", F.octet_length("b").cast("long").alias("n"), F.md5("b").alias("h"))


# Spans


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.unnest(views.traces(spark, d))


_KIND_SQL = "['unspecified', 'internal', 'server', 'client', 'producer', 'consumer'][kind + 1]"
_STATUS_SQL = "['unset', 'ok', 'error'][status_code + 1]"
_BOUNDS_SQL = "[" + ", ".join(str(b) for b in DURATION_BOUNDS) + "]::DOUBLE[]"
_AT_SQL = f"len(list_filter({_BOUNDS_SQL}, lambda b: b < (end_ns - start_ns) / 1e9))"
_SPAN_DAY = f"(end_ns // 1000000000) - (end_ns // 1000000000) % {DAY}"


def _point_day() -> Column:
    return window_start(F.floor(F.col("time_unix_nano") / 1_000_000_000), DAY).alias("window_start")


@query(f"WITH {views.SPANS_SQL} SELECT service, start_ns, end_ns, kind, status_code, route, (exception IS NOT NULL) AS has_event FROM spans")
def p4_unnest_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(F.col("resource")["service.name"].alias("service"), F.col("start_unix_nano").alias("start_ns"), F.col("end_unix_nano").alias("end_ns"), "kind", "status_code", F.col("attributes")["http.route"].alias("route"), (F.size("events") > 0).alias("has_event"))


@query(f"WITH {views.SPANS_SQL} SELECT service, {_KIND_SQL} AS span_kind, {_STATUS_SQL} AS status, route, count(*) AS n, round(sum((end_ns - start_ns) / 1e9), 4) AS seconds FROM spans GROUP BY ALL")
def p10_span_dimensions(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).withColumns({"l": spans.dimensions(["http.route"]), "sec": spans.duration_seconds(F.col("start_unix_nano"), F.col("end_unix_nano"))})
    l = F.col("l")  # noqa: E741
    return s.groupBy(l["service.name"].alias("service"), l["span.kind"].alias("span_kind"), l["status.code"].alias("status"), l["http.route"].alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sec"), 4).alias("seconds"))


@query(f"WITH {views.SPANS_SQL} SELECT service, {_SPAN_DAY} AS window_start, route, {_KIND_SQL} AS span_kind, count(*)::DOUBLE AS requests FROM spans GROUP BY ALL")
def g1_requests(spark: SparkSession, d: str) -> DataFrame:
    p = spans.to_points(_spans(spark, d), ["http.route"]).where("name = 'requests_total'")
    return p.groupBy(F.col("resource")["service.name"].alias("service"), _point_day(), F.col("labels")["http.route"].alias("route"), F.col("labels")["span.kind"].alias("span_kind")).agg(F.sum("value").alias("requests"))


@query(f"WITH {views.SPANS_SQL} SELECT service, {_SPAN_DAY} AS window_start, exception, count(*)::DOUBLE AS errors FROM spans WHERE status_code = 2 OR exception IS NOT NULL GROUP BY ALL")
def g2_errors(spark: SparkSession, d: str) -> DataFrame:
    p = spans.to_points(_spans(spark, d), ["http.route"]).where("name = 'errors_total'")
    return p.groupBy(F.col("resource")["service.name"].alias("service"), _point_day(), F.col("labels")["exception.type"].alias("exception")).agg(F.sum("value").alias("errors"))


@query(f"WITH {views.SPANS_SQL} SELECT service, {_AT_SQL} AS bucket, count(*) AS n FROM spans GROUP BY ALL")
def g3_duration_hist(spark: SparkSession, d: str) -> DataFrame:
    p = spans.to_points(_spans(spark, d)).where("name = 'duration_seconds'")
    at = F.array_position("counts", F.lit(1).cast("long")) - 1
    return p.groupBy(F.col("resource")["service.name"].alias("service"), at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, len(list_filter({_BOUNDS_SQL}, lambda b: b < value / 100)) AS bucket FROM events")
def g4_bucket_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", spans.bucket_index(F.col("value") / 100).cast("long").alias("bucket"))


@query(
    f"""WITH {views.SPANS_SQL}, x AS (SELECT service, {_SPAN_DAY} AS window_start, (status_code = 2)::INT AS bad, (status_code = 2 OR exception IS NOT NULL)::INT AS failed, ({_BOUNDS_SQL})[{_AT_SQL} + 1] AS bound FROM spans),
g AS (SELECT service, window_start, count(*) + sum(failed) AS req, count(*) - sum(bad) AS ok, sum(bad) + sum(failed) AS err, count(*) + sum(failed) + count(bound) AS n,
      coalesce(quantile_cont(bound, 0.5), 0) AS p50, coalesce(quantile_cont(bound, 0.95), 0) AS p95, coalesce(quantile_cont(bound, 0.99), 0) AS p99 FROM x GROUP BY ALL)
SELECT service, window_start, n::BIGINT AS count, round(req / {DAY}.0, 6) AS rps, round(err / (ok + err), 6) AS error_rate, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99,
       'summary service=' || service || ' rps=' || printf('%.6f', round(req / {DAY}.0, 6)) || ' error_rate=' || printf('%.6f', round(coalesce(err / (ok + err), 0), 6)) || ' count=' || n::BIGINT AS summary
FROM g"""
)
def summ_red_from_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.summarize_points(spans.to_points(_spans(spark, d)), DAY)
    return _round(rows.select("service", "window_start", "count", "rps", "error_rate", "p50", "p95", "p99", "summary"), 6, "rps", "error_rate", "p50", "p95", "p99")


_MONTH = 30 * DAY


@query(
    f"""WITH s AS (SELECT l_returnflag AS service, epoch_us(l_shipdate) // 1000000 AS ts, l_linenumber % 3 AS which, l_linestatus, l_quantity AS v, list_filter({_BOUNDS_SQL}, lambda b: b >= l_discount)[1] AS le FROM lineitem),
x AS (SELECT service, ts - ts % {_MONTH} AS window_start, which, v, le, l_linestatus = 'O' AS ok FROM s),
g AS (SELECT service, window_start, sum(CASE WHEN which > 0 THEN v ELSE 0 END) AS req, sum(CASE WHEN which = 1 AND ok THEN v ELSE 0 END) AS ok, sum(CASE WHEN which = 2 OR (which = 1 AND NOT ok) THEN v ELSE 0 END) AS err, sum(floor(v))::BIGINT AS n FROM x GROUP BY ALL),
q AS (SELECT service, window_start, quantile_cont(le, 0.5) AS p50, quantile_cont(le, 0.95) AS p95, quantile_cont(le, 0.99) AS p99 FROM (SELECT service, window_start, le, unnest(range(least(floor(v), 50)::BIGINT)) FROM x WHERE which = 0) GROUP BY ALL)
SELECT service, window_start, n AS count, round(req / {_MONTH}.0, 6) AS rps, round(coalesce(err / nullif(ok + err, 0), 0), 6) AS error_rate, round(coalesce(p50, 0), 6) AS p50, round(coalesce(p95, 0), 6) AS p95, round(coalesce(p99, 0), 6) AS p99
FROM g LEFT JOIN q USING (service, window_start)"""
)
def promrw_red(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.summarize_prometheus(views.prom_samples(spark, d), _MONTH)
    return _round(rows.select("service", "window_start", "count", "rps", "error_rate", "p50", "p95", "p99"), 6, "rps", "error_rate", "p50", "p95", "p99")


@query("""SELECT event_id, event_type IN ('view', 'click') AS ok FROM events""")
def f6_ok_status(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("event_type") == "view", "2xx").when(F.col("event_type") == "click", "UNSET").when(F.col("event_type") == "error", "500").otherwise("error")
    return table(spark, d, "events").select("event_id", metrics.is_ok(code).alias("ok"))


# State along time


@query(f"WITH {views.COUNTERS_SQL} SELECT event_id, greatest(v - coalesce(lag(v) OVER (PARTITION BY service, event_type ORDER BY t), 0), 0) AS delta FROM counters")
def t1_counter_delta(spark: SparkSession, d: str) -> DataFrame:
    p = views.counter_points(spark, d)
    keyed = p.withColumn("series", metrics.series_key(F.col("name"), F.col("resource"), F.col("labels")))
    return metrics.counter_delta(keyed, "series", ["time_unix_nano"], "value").select("event_id", "delta")


@query(f"WITH {views.COUNTERS_SQL} SELECT event_id, " + ", ".join(f"greatest(b{i} - coalesce(lag(b{i}) OVER (PARTITION BY service, event_type ORDER BY t), 0), 0) AS d{i}" for i in range(3)) + " FROM counters")
def t2_bucket_delta(spark: SparkSession, d: str) -> DataFrame:
    return metrics.to_delta(views.counter_points(spark, d)).select("event_id", *[F.col("counts")[i].alias(f"d{i}") for i in range(3)])


_Z = ", ".join(f"CASE WHEN coalesce(stddev_samp({f}) OVER w, 0) <= 1e-9 THEN 0 ELSE round(({f} - avg({f}) OVER w) / stddev_samp({f}) OVER w, 4) END AS z_{f}" for f in ("p99", "error_rate", "rps"))


#: Every row has a service and finite measures: unknown, and 0 for null, NaN and infinite.
_SERIES_SQL = "agg AS (SELECT agg_id, coalesce(service, 'unknown') AS service, window_start, " + ", ".join(f"CASE WHEN isfinite({m}) THEN {m} ELSE 0 END AS {m}" for m in ("p99", "error_rate", "rps")) + " FROM aggregates)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    measures = {m: F.when(F.abs(m) < float("inf"), F.col(m)).otherwise(0.0) for m in ("p99", "error_rate", "rps")}
    return table(spark, d, "aggregates").withColumns(measures | {"service": F.coalesce("service", F.lit("unknown"))})


@query(f"WITH {_SERIES_SQL} SELECT agg_id, {_Z} FROM agg WINDOW w AS (PARTITION BY service ORDER BY window_start, agg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def t4_zscore(spark: SparkSession, d: str) -> DataFrame:
    z = series.running_zscore(_series(spark, d), "service", ["window_start", "agg_id"], ["p99", "error_rate", "rps"])
    return z.select("agg_id", *[(F.round(f"z_{f}", 4) + 0.0).alias(f"z_{f}") for f in ("p99", "error_rate", "rps")])


@query(
    f"""WITH {_SERIES_SQL} SELECT agg_id, {", ".join(f"round(list_reduce(list_prepend(0.0::DOUBLE, list({f}) OVER w), lambda s, x: 0.3 * x + 0.7 * s), 6) AS ema_{f}" for f in ("rps", "p99"))}
FROM agg WINDOW w AS (PARTITION BY service ORDER BY window_start, agg_id ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)"""
)
def t5_ema(spark: SparkSession, d: str) -> DataFrame:
    e = series.exponential_average(_series(spark, d), "service", ["window_start", "agg_id"], ["rps", "p99"], 0.3)
    return _round(e.select("agg_id", "ema_rps", "ema_p99"), 6, "ema_rps", "ema_p99")


# Scores

_TREES = {"version": "iforest-v1", "trees": [
    {"nodes": [{"f": 0, "t": 0.3, "l": 1, "r": 2}, {"leaf": True, "size": 90}, {"f": 1, "t": 0.02, "l": 3, "r": 4}, {"leaf": True, "size": 100}, {"leaf": True, "size": 3}]},
    {"nodes": [{"f": 2, "t": 40.0, "l": 1, "r": 2}, {"f": 1, "t": 0.005, "l": 3, "r": 4}, {"leaf": True, "size": 9}, {"leaf": True, "size": 200}, {"leaf": True, "size": 40}]},
]}
_FEATURE_SQL = "coalesce(CASE WHEN isnan({0}) THEN 0 ELSE {0} END, 0)"
_P99, _ER, _RPS = (_FEATURE_SQL.format(c) for c in ("p99", "error_rate", "rps"))


@query(
    f"""SELECT agg_id, round(least(greatest(exp(-((CASE WHEN {_P99} <= 0.3 THEN 1 ELSE 2 END) + (CASE WHEN {_RPS} <= 40 THEN 2 ELSE 1 END)) / 2.0 / {forest.mean_path(256)!r}), 0), 1), 6) AS anomaly_score FROM aggregates"""
)
def m3_iforest_score(spark: SparkSession, d: str) -> DataFrame:
    trees = forest.load_model({"model": _TREES})
    return _round(forest.with_score(table(spark, d, "aggregates"), trees).select("agg_id", "anomaly_score"), 6, "anomaly_score")


@query(f"SELECT agg_id, {_P99} AS x0, {_ER} AS x1, {_RPS} AS x2, 0.0::DOUBLE AS x3 FROM aggregates")
def m1_features(spark: SparkSession, d: str) -> DataFrame:
    x = forest.feature_vector(("p99", "error_rate", "rps", "other"))
    return table(spark, d, "aggregates").select("agg_id", *[c.alias(f"x{i}") for i, c in enumerate(x)])


# Vectors


#: Fixed-point text of a measure: null as 0, NaN and infinite as Java writes them.
_FIXED_SQL = "CASE WHEN isnan({0}) THEN 'NaN' WHEN isinf({0}) THEN if({0} > 0, 'Infinity', '-Infinity') ELSE printf('%.6f', round(coalesce({0}, 0), 6)) END"


@query(
    f"""SELECT agg_id, concat_ws(' ', 'kind=trace', 'service=' || service, 'ts_start=' || window_start, 'ts_end=' || window_end, {", ".join(f"'{c}=' || {_FIXED_SQL.format(c)}" for c in ("p50", "p95", "p99", "rps", "error_rate"))},
nullif(array_to_string(list_filter(['source=' || nullif(labels['source'], ''), 'nothing=' || nullif(labels['nothing'], ''), 'env=' || nullif(labels['env'], ''), 'operation=' || nullif(labels['operation'], '')], lambda x: x IS NOT NULL)[:2], ' '), ''),
'summary=' || nullif(summary, '')) AS text FROM aggregates"""
)
def v3_trace_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aggregates").select("agg_id", vectors.trace_text(["source", "nothing", "env", "operation"], 2).alias("text"))


_V4_SQL = "[p50, (p50 + p95) / 2, p95, p99, rps, error_rate, error_rate * count, count / (1 + window_end - window_start)]"


_PCA = {"rows": 2, "cols": 8, "data": [0.5, -0.25, 0.1, 0.3, 0.01, 2.0, 0.0, 0.05, -0.4, 0.2, 0.3, -0.1, 0.02, 1.0, 0.5, -0.03], "center": [0.1, 0.2, 0.3, 0.4, 10.0, 0.01, 1.0, 5.0], "scale": [0.1, 0.2, 0.2, 0.3, 20.0, 0.02, 0.0, 8.0]}
_PCA_ROWS = ", ".join(
    "list_sum(list_transform(range(1, 9), lambda i: " + str(_PCA["data"][r * 8 : r * 8 + 8]) + f"[i] * (v[i] - {_PCA['center']}[i]) / (CASE WHEN {_PCA['scale']}[i] > 1e-9 THEN {_PCA['scale']}[i] ELSE 1 END)))" for r in range(2)
)


# Over every row of aggregates: null measures count as 0, NaN and infinite go on as they are.
_WHOLE_SQL = "agg AS (SELECT agg_id, service, window_start, window_end, labels, summary, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("count", "rps", "error_rate", "p50", "p95", "p99")) + " FROM aggregates)"


@query(
    f"""WITH {_WHOLE_SQL} SELECT agg_id, concat_ws(' ', 'kind=log', 'service=' || service, 'ts_start=' || window_start, 'ts_end=' || window_end, 'env=' || labels['env'], 'source=' || labels['source'],
'success=' || CASE WHEN error_rate > 0 THEN 'false' ELSE 'true' END, 'summary=' || nullif(summary, '')) AS text FROM agg"""
)
def v2_log_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aggregates").select("agg_id", vectors.log_text(["source", "env", "success"]).alias("text"))


@query(
    f"""WITH {_WHOLE_SQL} SELECT agg_id, concat_ws(' ', 'service=' || service, 'window=' || strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(make_timestamp(window_end * 1000000), '%Y-%m-%dT%H:%M:%SZ'),
{", ".join(f"'{c}=' || {_FIXED_SQL.format(c)}" for c in ("rps", "error_rate", "p50", "p95", "p99"))}, 'count=' || count) AS text FROM agg"""
)
def v5_fallback_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aggregates").select("agg_id", vectors.fallback_summary().alias("text"))


@query(f"WITH {_WHOLE_SQL}, v AS (SELECT agg_id, {_V4_SQL} AS v FROM agg) SELECT agg_id, i, round(v[i], 8) AS x FROM v, range(1, 9) r(i)")
def v4_metric_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "aggregates").select("agg_id", F.posexplode(vectors.metric_features()).alias("i", "x"))
    return v.select("agg_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 8).alias("x"))


@query(
    f"WITH {_WHOLE_SQL}, v AS (SELECT agg_id, {_V4_SQL} AS v FROM agg), p AS (SELECT agg_id, [{_PCA_ROWS}] AS p FROM v) "
    "SELECT agg_id, round(p[1] / sqrt(p[1] * p[1] + p[2] * p[2]), 6) AS a, round(p[2] / sqrt(p[1] * p[1] + p[2] * p[2]), 6) AS b FROM p"
)
def v6_pca(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "aggregates").select("agg_id", vectors.pca(vectors.metric_features(), vectors.load_pca({"pca_inline": _PCA})).alias("p"))
    return v.select("agg_id", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[1], 6).alias("b"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT vec_id, i, round(embedding[i]::DOUBLE / n, 6) AS x FROM n")
def v7_l2(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


_TOKENS_SQL = "t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS toks FROM documents)"


@query(f"WITH {_TOKENS_SQL}, x AS (SELECT unnest(toks) AS token FROM t) SELECT token, count(*) AS n FROM x GROUP BY ALL")
def v8_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(vectors.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_TOKENS_SQL}, g AS (SELECT doc_id, len(toks) AS n, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1]))) AS gram FROM t),
h AS (SELECT doc_id, gram FROM g WHERE NOT list_has_any(string_split(gram, '_'), ['the', 'a']))
SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS n_distinct, min(gram) AS first_gram, max(gram) AS last_gram FROM h GROUP BY ALL"""
)
def v10_ngrams(spark: SparkSession, d: str) -> DataFrame:
    grams = vectors.ngrams(vectors.tokens(F.col("text")), 2, ("the", "a"))
    return table(spark, d, "documents").select("doc_id", F.explode(grams).alias("gram")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gram").alias("n_distinct"), F.min("gram").alias("first_gram"), F.max("gram").alias("last_gram"))


_M64 = 18446744073709551616
_BYTE = "instr('0123456789abcdef', substr(hx, 2 * i - 1, 1)) * 16 + instr('0123456789abcdef', substr(hx, 2 * i, 1)) - 17"
_FNV_A = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(hx) // 2 + 1), lambda i: ({_BYTE})::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M64}::UHUGEINT)"
_FNV_1 = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(hs) // 2 + 1), lambda i: ({_BYTE.replace('hx', 'hs')})::UHUGEINT)), lambda h, b: xor((h * 1099511628211::UHUGEINT) % {_M64}::UHUGEINT, b))"


@query(
    f"""WITH {_TOKENS_SQL}, x AS (SELECT doc_id, unnest(toks) AS token FROM t), n AS (SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL),
u AS (SELECT token, lower(hex(encode(token))) AS hx, lower(hex(encode('sign:' || token))) AS hs FROM (SELECT DISTINCT token FROM x)),
h AS (SELECT token, ({_FNV_A} % 384)::INT AS idx, CASE WHEN {_FNV_1} % 2 = 1 THEN -1 ELSE 1 END AS sign FROM u),
w AS (SELECT doc_id, idx, sum(n * sign)::BIGINT AS weight FROM n JOIN h USING (token) GROUP BY ALL)
SELECT doc_id, idx, weight FROM w WHERE weight <> 0"""
)
def v11_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", vectors.hash_terms(vectors.tokens(F.col("text"))).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("idx", "weight")).where("weight <> 0").select("doc_id", "idx", F.col("weight").cast("long").alias("weight"))


_TEXT_SQL = f"""concat_ws(' ', 'service=' || service, 'window=' || strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(make_timestamp(window_end * 1000000), '%Y-%m-%dT%H:%M:%SZ'),
{", ".join(f"'{c}=' || {_FIXED_SQL.format(c)}" for c in ("rps", "error_rate", "p50", "p95", "p99"))}, 'count=' || count)"""
_LOG_SQL = """concat_ws(' ', 'kind=log', 'service=' || service, 'ts_start=' || window_start, 'ts_end=' || window_end, 'env=' || nullif(labels['env'], ''), 'success=' || CASE WHEN error_rate > 0 THEN 'false' ELSE 'true' END, 'summary=' || nullif(summary, ''))"""
_SPAN_SQL = f"""concat_ws(' ', 'kind=trace', 'service=' || service, 'ts_start=' || window_start, 'ts_end=' || window_end, {", ".join(f"'{c}=' || {_FIXED_SQL.format(c)}" for c in ("p50", "p95", "p99", "rps", "error_rate"))}, 'summary=' || nullif(summary, ''))"""


@query(
    f"""WITH {_WHOLE_SQL}, s AS (SELECT *, lower(coalesce(labels['source'], '')) AS src FROM agg), v AS (SELECT agg_id, {_V4_SQL} AS v FROM s WHERE src = 'metrics'), p AS (SELECT agg_id, [{_PCA_ROWS}] AS p FROM v),
t AS (SELECT agg_id, CASE src WHEN 'logs' THEN {_LOG_SQL} WHEN 'traces' THEN {_SPAN_SQL} ELSE CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary ELSE {_TEXT_SQL} END END AS text FROM s WHERE src <> 'metrics'),
k AS (SELECT agg_id, list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda x: x <> '') AS toks FROM t), g AS (SELECT agg_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1]))) AS token FROM k),
n AS (SELECT agg_id, token, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT token, lower(hex(encode(token))) AS hx, lower(hex(encode('sign:' || token))) AS hs FROM (SELECT DISTINCT token FROM g)),
h AS (SELECT token, ({_FNV_A} % 384)::INT AS idx, CASE WHEN {_FNV_1} % 2 = 1 THEN -1 ELSE 1 END AS sign FROM u), w AS (SELECT agg_id, idx, sum(n * sign)::DOUBLE AS x FROM n JOIN h USING (token) GROUP BY ALL),
z AS (SELECT agg_id, idx::INT AS i, x / sqrt(sum(x * x) OVER (PARTITION BY agg_id)) AS x FROM w WHERE x <> 0)
SELECT agg_id, i, round(x, 4) AS x FROM z UNION ALL SELECT agg_id, (i - 1)::INT, round(p[i] / sqrt(p[1] * p[1] + p[2] * p[2]), 4) FROM p, range(1, 3) r(i)"""
)
def v1_vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """The components of v1_vectorize that aren't 0; of numeric vectors all."""
    v = v1_vectorize(spark, d).select("agg_id", F.lower("source").alias("source"), F.posexplode("vector").alias("i", "x"))
    return v.where("x <> 0 OR source = 'metrics'").select("agg_id", "i", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query()
def v1_vectorize(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.vectorize(table(spark, d, "aggregates"), include=["env"], pca_model=vectors.load_pca({"pca_inline": _PCA}))
    return rows.select("agg_id", F.col("labels")["source"].alias("source"), F.size("vector").alias("dim"), "vector")


# Filters


@query("SELECT envelope_id, kind FROM envelopes WHERE coalesce(attrs['env'] = 'prod', true)")
def f1_pre_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_envelopes(table(spark, d, "envelopes"), 'attrs["env"] == "prod"').select("envelope_id", "kind")


@query("SELECT agg_id FROM aggregates WHERE coalesce((anomaly_score >= 0.8 AND NOT isnan(anomaly_score)) OR (error_rate > 0.05 AND NOT isnan(error_rate)), true)")
def f2_agg_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_aggregates(table(spark, d, "aggregates"), "anomaly_score >= 0.8 || error_rate > 0.05").select("agg_id")


@query("SELECT agg_id FROM aggregates WHERE coalesce(NOT (labels['env'] = 'prod') AND (CASE WHEN count > 100 THEN starts_with(service, 'b') ELSE service IN ('ledger-api', 'parcel-api') END), true)")
def f3_fail_open(spark: SparkSession, d: str) -> DataFrame:
    expression = '!(labels.env == "prod") && (count > 100 ? service.startsWith("b") : service in ["ledger-api", "parcel-api"])'
    return filter_aggregates(table(spark, d, "aggregates"), expression).select("agg_id")


_BODY_SQL = """b AS (SELECT envelope_id, trim(try(decode(bytes))) AS t FROM envelopes), j AS (SELECT envelope_id, CASE WHEN starts_with(t, '{') THEN try_cast(t AS JSON) END AS j FROM b)"""


@query(f"""WITH {_BODY_SQL} SELECT envelope_id FROM j WHERE coalesce(CASE WHEN json_type(j->'latency_ms') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j->>'latency_ms')::DOUBLE > 100 END OR CASE WHEN json_exists(j, '$.level') THEN coalesce(json_type(j->'level') = 'VARCHAR' AND j->>'level' = 'error', false) END, true)""")
def f1_log_number(spark: SparkSession, d: str) -> DataFrame:
    return filter_envelopes(table(spark, d, "envelopes"), 'log.latency_ms > 100 || log.level == "error"', on="logs").select("envelope_id")


def _line_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_logs").select("feed", "file_no", "line_no", F.lit("json_logs").alias("kind"), F.col("raw").cast("binary").alias("bytes"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(0).cast("long").alias("ts_unix"))


_LINES_SQL = "l AS (SELECT feed, file_no, line_no, CASE WHEN starts_with(trim(raw), '{') THEN try_cast(raw AS JSON) END AS j FROM raw_logs)"


@query(f"""WITH {_LINES_SQL} SELECT feed, file_no, line_no FROM l WHERE coalesce(CASE WHEN json_type(j->'service') = 'OBJECT' AND json_exists(j, '$.service.name') THEN (j->'service'->>'name') LIKE 'l%' END, true)""")
def f1_log_nested(spark: SparkSession, d: str) -> DataFrame:
    return filter_envelopes(_line_envelopes(spark, d), 'log.service.name.startsWith("l")', on="logs").select("feed", "file_no", "line_no")


@query(f"""WITH {_LINES_SQL} SELECT feed, file_no, line_no FROM l WHERE coalesce(CASE WHEN json_type(j->'tags') = 'ARRAY' THEN len(list_filter(CAST(j->'tags' AS VARCHAR[]), lambda t: t = 'edge' OR starts_with(t, 're'))) > 0 END, true)""")
def f1_log_macro(spark: SparkSession, d: str) -> DataFrame:
    return filter_envelopes(_line_envelopes(spark, d), 'log.tags.exists(t, t == "edge" || t.startsWith("re"))', on="logs").select("feed", "file_no", "line_no")


#: Expressions that fail on some or all rows, and the SQL of what they keep.
_FAILURES = (
    ("kind in [1, 2]", "false"), ("attrs.env.size() > 3", "coalesce(length(attrs['env']) > 3, true)"), ("kind.http.status == 500", "true"),
    ('nothing > 1 && attrs.env == "prod"', "coalesce(attrs['env'] = 'prod', true)"), ('nothing > 1 || attrs.env == "prod"', "true"), ("ts_unix / 0 == 1 && ts_unix > 1709520000", "coalesce(ts_unix > 1709520000, true)"),
    ('kind.matches("[")', "true"), ("kind < 5", "true"), ("((", "true"), ("unknown(kind) || kind == \"traces\"", "true"), ("ts_unix + 1.5 > 0.0", "true"), ("kind", "true"),
)


@query(" UNION ALL ".join(f"SELECT {i} AS expression, envelope_id FROM envelopes WHERE {sql}" for i, (_, sql) in enumerate(_FAILURES)))
def f3_failures(spark: SparkSession, d: str) -> DataFrame:
    return landing.fan_in(*[filter_envelopes(table(spark, d, "envelopes"), text).select(F.lit(i).alias("expression"), "envelope_id") for i, (text, _) in enumerate(_FAILURES)])


@query("SELECT agg_id FROM aggregates")
def f4_keep_all(spark: SparkSession, d: str) -> DataFrame:
    a = filter_aggregates(table(spark, d, "aggregates"), "error_rate > 0.05", drop_non_matching=False)
    return filter_aggregates(a, "this is (not an expression").select("agg_id")


# OTLP


@query(
    """SELECT event_id, 'svc-' || (user_id % 5) AS service, lower(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END) AS level, (epoch_us(ts) * 1000)::VARCHAR AS ts_nano, event_type AS body,
(props::JSON->>'k') AS k, (user_id % 7)::VARCHAR AS shard, '1.25' AS ratio, 'true' AS ready, printf('%032x', event_id) AS trace_id, 'app' AS scope, false AS has_span FROM events"""
)
def p7_flatten_logs(spark: SparkSession, d: str) -> DataFrame:
    flat = otlp_logs.flatten(views.otlp_log_records(spark, d))
    at = lambda k: F.col("fields")[k]
    return flat.select(
        "event_id", at("service").alias("service"), at("level").alias("level"), at("timestamp_unix_nano").alias("ts_nano"), at("body").alias("body"), at("k").alias("k"), at("resource.shard").alias("shard"),
        at("resource.ratio").alias("ratio"), at("resource.ready").alias("ready"), at("trace_id").alias("trace_id"), at("scope.name").alias("scope"), F.map_contains_key("fields", "span_id").alias("has_span"),
    )


def _encoded(rows: DataFrame, message: str, build) -> DataFrame:
    """One encoded message a row: what a gateway would have written."""
    @F.pandas_udf("binary")
    def make(x: pd.DataFrame) -> pd.Series:
        return pd.Series([otlp.encode(message, build(r)) for r in x.to_dict("records")], dtype=object)

    return rows.select(make(F.struct(*rows.columns)).alias("bytes"))


def _text(key: str, value: str) -> dict:
    return {"key": key, "value": {"string": value}}


@query(f"WITH {views.SPANS_SQL} SELECT service, route, kind, status_code, start_ns, end_ns, exception FROM spans")
def d1_otlp_traces(spark: SparkSession, d: str) -> DataFrame:
    flat = _spans(spark, d).select(F.col("resource")["service.name"].alias("service"), F.col("attributes")["http.route"].alias("route"), "kind", "status_code", "start_unix_nano", "end_unix_nano", F.try_element_at("events", F.lit(1))["attributes"]["exception.type"].alias("exception"))

    def build(r: dict) -> dict:
        events = [{"name": "Exception", "attributes": [_text("exception.type", r["exception"])]}] if isinstance(r["exception"], str) else []
        span = {"kind": r["kind"], "start": r["start_unix_nano"], "end": r["end_unix_nano"], "attributes": [_text("http.route", r["route"])], "events": events, "status": {"code": r["status_code"]}}
        return {"resource_spans": [{"resource": {"attributes": [_text("service.name", r["service"])]}, "scope_spans": [{"spans": [span]}]}]}

    rows = otlp.decode_bodies(_encoded(flat, "Traces", build), "bytes", "traces")
    return rows.select(F.col("resource")["service.name"].alias("service"), F.col("attributes")["http.route"].alias("route"), "kind", "status_code", F.col("start_unix_nano").alias("start_ns"), F.col("end_unix_nano").alias("end_ns"), F.try_element_at("events", F.lit(1))["attributes"]["exception.type"].alias("exception"))


@query(f"WITH {views.COUNTERS_SQL} SELECT service, event_type, t, v, b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2 FROM counters")
def d2_otlp_metrics(spark: SparkSession, d: str) -> DataFrame:
    flat = views.counter_points(spark, d).select(F.col("resource")["service.name"].alias("service"), F.col("labels")["type"].alias("type"), "value", "counts", "time_unix_nano")

    def build(r: dict) -> dict:
        point = {"time": r["time_unix_nano"], "attributes": [_text("type", r["type"])]}
        sums = {"name": "hits", "sum": {"temporality": 2, "points": [point | {"as_int": int(r["value"])}]}}
        hist = {"name": "hits", "histogram": {"temporality": 2, "points": [point | {"bounds": [50.0, 150.0], "counts": [int(c) for c in r["counts"]]}]}}
        return {"resource_metrics": [{"resource": {"attributes": [_text("service.name", r["service"])]}, "scope_metrics": [{"metrics": [sums, hist]}]}]}

    p = otlp.decode_bodies(_encoded(flat, "Metrics", build), "bytes", "metrics")
    key = [F.col("resource")["service.name"].alias("service"), F.col("labels")["type"].alias("event_type"), F.col("time_unix_nano").alias("t")]
    counts = F.first("counts", ignorenulls=True)
    return p.groupBy(*key).agg(F.max("value").alias("v"), *[counts[i].alias(f"b{i}") for i in range(3)])


@query("SELECT l_orderkey::VARCHAR AS job, l_quantity AS v, epoch_us(l_shipdate) // 1000 AS ts_ms FROM lineitem")
def d3_promrw(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem")
    flat = item.select(F.col("l_orderkey").cast("string").alias("job"), F.col("l_quantity").alias("v"), (F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate")) * 1000).alias("ts_ms"))
    build = lambda r: {"timeseries": [{"labels": [{"name": "job", "value": r["job"]}], "samples": [{"value": r["v"], "timestamp": int(r["ts_ms"])}]}]}
    rows = otlp.decode_bodies(_encoded(flat, "WriteRequest", build), "bytes", "prom_rw")
    return rows.select(F.col("labels")["job"].alias("job"), F.col("value").alias("v"), "ts_ms")


@query("SELECT event_type AS body, 'svc-' || (user_id % 5) AS service, epoch_us(ts) * 1000 AS t, count(*) AS n FROM events GROUP BY ALL")
def d4_otlp_logs(spark: SparkSession, d: str) -> DataFrame:
    flat = views.otlp_log_records(spark, d).select(F.get_json_object("resource", "$['service.name']").alias("service"), "body", "time_unix_nano")
    build = lambda r: {"resource_logs": [{"resource": {"attributes": [_text("service.name", r["service"])]}, "scope_logs": [{"records": [{"time": r["time_unix_nano"], "body": {"string": r["body"]}}]}]}]}
    rows = otlp_logs.flatten(otlp.decode_bodies(_encoded(flat, "Logs", build), "bytes", "logs"))
    return rows.groupBy(F.col("fields")["body"].alias("body"), F.col("fields")["service"].alias("service"), F.col("time_unix_nano").alias("t")).agg(F.count(F.lit(1)).alias("n"))


# Sinks


@query("SELECT coalesce(service, '') || ':' || window_start || ':' || coalesce(labels['env'], '') AS id, count(*) AS n FROM aggregates GROUP BY ALL")
def k2_id_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aggregates").groupBy(stores.render_id("{{.Service}}:{{.WindowStart}}:{{.Labels.env}}").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH x AS (SELECT coalesce(service, '') || ':' || window_start AS id, agg_id, count AS n FROM aggregates), s AS (SELECT DISTINCT id FROM x WHERE agg_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY agg_id) AS k FROM x WHERE id NOT IN (SELECT id FROM s)) SELECT id, agg_id, n FROM r WHERE k = 1"""
)
def k3_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aggregates").withColumn("id", stores.render_id())
    stored = rows.where("agg_id % 10 = 0").select("id")
    return stores.insert_if_absent(rows.select("id", "agg_id", F.col("count").alias("n")), stored, "id", ["agg_id"])


_OBJECT_SQL = ", ".join(f"CASE WHEN isfinite({m}) THEN round({m}, 9) END AS {m}" for m in ("rps", "error_rate", "p50", "p95", "p99", "anomaly_score"))


@query(f"SELECT coalesce(service, '') || ':' || window_start AS id, 'Agg' AS class, agg_id, count AS n, window_end, labels['env'] AS env, summary, {_OBJECT_SQL} FROM aggregates")
def k1_vector_objects(spark: SparkSession, d: str) -> DataFrame:
    o = stores.vector_objects(table(spark, d, "aggregates"), "Agg")
    at = lambda k: F.get_json_object("object", f"$.properties.{k}")
    measures = [F.round(at(m).cast("double"), 9).alias(m) for m in ("rps", "error_rate", "p50", "p95", "p99", "anomaly_score")]
    return o.select(F.get_json_object("object", "$.id").alias("id"), F.get_json_object("object", "$.class").alias("class"), at("agg_id").cast("long").alias("agg_id"), at("count").cast("long").alias("n"), at("window_end").cast("long").alias("window_end"), at("labels.env").alias("env"), at("summary").alias("summary"), *measures)


@query("SELECT s.sink, count(*) AS n, count(DISTINCT agg_id) AS n_ids, sum(count)::BIGINT AS total FROM aggregates, (SELECT unnest(['first', 'second']) AS sink) s GROUP BY ALL")
def k4_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One batch to two stores, read back from both."""
    root = f"{ensure_checkpoint_dir(spark)}/fan-out-{uuid.uuid4().hex}"
    stores.fan_out(table(spark, d, "aggregates"), [stores.parquet_writer(f"{root}/first"), stores.parquet_writer(f"{root}/second", ["service"])])
    read = [spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("sink"), "agg_id", "count") for n in ("first", "second")]
    return landing.fan_in(*read).groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("agg_id").alias("n_ids"), F.sum("count").alias("total"))


# Operators without a query of their own so far


@query(f"WITH {views.LOGS_SQL} SELECT service, ts - ts % 3600 AS window_start, least(count(*), 16) AS n, 0::BIGINT AS foreign_values FROM logs WHERE latency_ms IS NOT NULL GROUP BY ALL")
def a15_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the samples, and how many of their values no record of the group holds."""
    rows = views.logs(spark, d)
    held = logs.windowed(rows, 3600).where("latency_ms IS NOT NULL").select("service", "window_start", F.col("latency_ms").alias("value"), F.lit(True).alias("held")).distinct()
    sample = logs.reservoir(rows, 3600, cap=16)
    return sample.join(held, ["service", "window_start", "value"], "left").groupBy("service", "window_start").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("held").isNull()).alias("foreign_values"))


@query(
    f"""SELECT agg_id, round(least(greatest(exp(-((CASE WHEN {_P99} <= 0.3 THEN 1 ELSE 2 END) + (CASE WHEN {_RPS} <= 40 THEN 2 ELSE 1 END) + (CASE WHEN {_ER} <= 0.01 THEN 64 ELSE 1 END)) / 3.0 / {forest.mean_path(256)!r}), 0), 1), 6) AS anomaly_score FROM aggregates"""
)
def m2_arrow_walk(spark: SparkSession, d: str) -> DataFrame:
    """A forest with a cycle, which can't become an expression: the walk in Arrow batches ends after 64 steps."""
    trees = forest.load_model({"model": {"trees": [*_TREES["trees"], {"nodes": [{"f": 1, "t": 0.01, "l": 0, "r": 1}, {"leaf": True}]}]}})
    x = forest.feature_vector()
    return table(spark, d, "aggregates").select("agg_id", F.round(forest.score(x, trees), 6).alias("anomaly_score"))


def _nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every counter point as a nested request with a sum, a histogram and a gauge."""
    p = views.counter_points(spark, d)
    attrs = F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    even = F.col("event_id") % 2 == 0
    number = F.struct(attrs.alias("attributes"), F.when(even, F.col("value").cast("long")).alias("as_int"), F.when(~even, F.col("value") + 0.5).alias("as_double"), "time_unix_nano")
    bucket = F.struct(attrs.alias("attributes"), F.col("bounds").alias("explicit_bounds"), F.col("counts").alias("bucket_counts"), "time_unix_nano")
    sums, hist = F.struct(F.lit(2).alias("temporality"), F.array(number).alias("points")), F.struct(F.lit(1).alias("temporality"), F.array(bucket).alias("points"))
    metric = lambda name, kind, s, h: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), s.alias("sum"), h.alias("histogram"))
    none = lambda x: F.when(F.lit(False), x)
    metrics_of = F.array(metric("hits_requests_total", "sum", sums, none(hist)), metric("hits_seconds", "histogram", none(sums), hist), metric("load", "gauge", none(sums), none(hist)))
    resource = F.struct(F.col("resource").alias("attributes"))
    return p.select("event_id", F.array(F.struct(resource.alias("resource"), F.array(F.struct(metrics_of.alias("metrics"))).alias("scope_metrics"))).alias("resource_metrics"))


@query(
    f"""WITH {views.COUNTERS_SQL}, k AS (SELECT *, unnest(['sum', 'histogram', 'gauge']) AS kind FROM counters)
SELECT service, kind, CASE kind WHEN 'sum' THEN 2 WHEN 'histogram' THEN 1 END AS temporality, CASE WHEN kind <> 'gauge' THEN event_type END AS type, CASE WHEN kind <> 'gauge' THEN t END AS t,
CASE WHEN kind = 'sum' THEN v + (event_id % 2) * 0.5 END AS value, CASE WHEN kind = 'histogram' THEN b1 END AS middle, CASE WHEN kind = 'histogram' THEN 50.0::DOUBLE END AS bound FROM k"""
)
def p5_unnest_points(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.unnest(_nested_metrics(spark, d))
    return p.select(F.col("resource")["service.name"].alias("service"), "kind", "temporality", F.col("labels")["type"].alias("type"), F.col("time_unix_nano").alias("t"), "value", F.col("counts")[1].alias("middle"), F.col("bounds")[0].alias("bound"))


@query(f"WITH {views.COUNTERS_SQL} SELECT event_id, v + (event_id % 2) * 0.5 AS value FROM counters")
def p14_point_value(spark: SparkSession, d: str) -> DataFrame:
    nested = _nested_metrics(spark, d)
    one = metrics.unnest(nested.withColumn("resource_metrics", F.transform("resource_metrics", lambda r: r.withField("resource.attributes", F.map_from_arrays(F.array(F.lit("id")), F.array(F.col("event_id").cast("string")))))))
    return one.where("kind = 'sum'").select(F.col("resource")["id"].cast("long").alias("event_id"), "value")


@query("SELECT DISTINCT 'svc-' || (user_id % 5) AS service, (epoch_us(ts) // 86400000000) * 86400 AS window_start, 0::BIGINT AS count, 0.0::DOUBLE AS rps, 0.0::DOUBLE AS error_rate, 0.0::DOUBLE AS p99 FROM events")
def a20_zero_rows(spark: SparkSession, d: str) -> DataFrame:
    gauges = views.counter_points(spark, d).withColumns({"kind": F.lit("other"), "value": F.lit(None).cast("double"), "bounds": F.lit(None).cast("array<double>"), "counts": F.lit(None).cast("array<long>")})
    return metrics.summarize_points(gauges, DAY).select("service", "window_start", "count", "rps", "error_rate", "p99")


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN user_id || '.0' WHEN 3 THEN '2.5' WHEN 4 THEN '["' || event_type || '", ' || user_id || '.0]'
WHEN 5 THEN '{"a": {"b": "' || event_type || '"}, "c": null}' ELSE lower(hex(encode(event_type))) END AS body FROM events"""
)
def d6_any_value(spark: SparkSession, d: str) -> DataFrame:
    def build(r: dict) -> dict:
        kind, name, user = r["event_id"] % 7, r["event_type"], r["user_id"]
        body = ({"string": name}, {"bool": user % 2 == 0}, {"int": user}, {"double": 2.5}, {"array": {"values": [{"string": name}, {"int": user}]}}, {"kvlist": {"values": [{"key": "a", "value": {"kvlist": {"values": [{"key": "b", "value": {"string": name}}]}}}, {"key": "c"}]}}, {"bytes": name.encode()})[kind]
        return {"resource_logs": [{"scope_logs": [{"records": [{"time": r["event_id"], "body": body}]}]}]}

    rows = otlp.decode_bodies(_encoded(table(spark, d, "events").select("event_id", "event_type", "user_id"), "Logs", build), "bytes", "logs")
    return rows.select(F.col("time_unix_nano").alias("event_id"), "body")


@query("SELECT event_id AS id, event_id % 3 <> 0 AS passed, CASE event_id % 3 WHEN 0 THEN 1 END AS kind FROM events")
def f9_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a span give it, bodies without one and foreign ones go on as they came."""

    def build(r: dict) -> bytes:
        if r["event_id"] % 3 == 2:
            return b"\xff" + r["event_type"].encode()
        spans_of = [{"kind": 1, "start": 5, "end": 6}] if r["event_id"] % 3 == 0 else []
        return otlp.encode("Traces", {"resource_spans": [{"resource": {"attributes": [_text("service.name", "a")]}, "scope_spans": [{"spans": spans_of}]}]})

    @F.pandas_udf("binary")
    def make(x: pd.DataFrame) -> pd.Series:
        return pd.Series([build(r) for r in x.to_dict("records")], dtype=object)

    e = table(spark, d, "events").select("event_id", make(F.struct("event_id", "event_type")).alias("bytes"))
    rows = otlp.decode_or_pass(e, "traces", ("event_id",))
    return rows.select(F.col("event_id").alias("id"), F.col("passed").isNotNull().alias("passed"), "kind")


@query(
    r"""WITH x AS (SELECT feed, file_no, unnest(string_split(t, chr(10))) AS line FROM (SELECT feed, file_no, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM raw_logs WHERE raw IS NOT NULL GROUP BY feed, file_no)),
y AS (SELECT feed, file_no, trim(line, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)) AS line FROM x) SELECT feed, file_no::BIGINT AS file_no, md5(line) AS h, count(*) AS n FROM y WHERE line <> '' GROUP BY ALL"""
)
def s11_auto_split(spark: SparkSession, d: str) -> DataFrame:
    """A broker message a file, split into one envelope a line."""
    raw = table(spark, d, "raw_logs").where("raw IS NOT NULL")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"])
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").cast("binary").alias("value")) for k in ("feed", "file_no")])
    messages = raw.groupBy("feed", "file_no").agg(F.array_join(lines, "\n").cast("binary").alias("value")).select("value", headers.alias("headers"), F.lit("2024-03-04").cast("timestamp").alias("timestamp"))
    e = brokers.broker_envelopes(messages, F.lit("logs"), ndjson=True)
    return e.where("kind = 'json_logs'").groupBy(F.col("attrs")["feed"].alias("feed"), F.col("attrs")["file_no"].cast("long").alias("file_no"), F.md5("bytes").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS ts_unix FROM events")
def s15_arrival(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "events").select(F.encode(F.col("event_id").cast("string"), "utf-8").alias("value"), F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))).alias("timestamp"))
    e = brokers.broker_envelopes(messages, F.lit("metrics"))
    return e.select(F.col("bytes").cast("string").cast("long").alias("event_id"), "ts_unix")
