"""The record types of the engine as Spark schemas."""

from __future__ import annotations

ENVELOPE = "kind string, bytes binary, attrs map<string,string>, ts_unix long"
AGGREGATE = (
    "service string, window_start long, window_end long, labels map<string,string>, locator string, count long, rps double, "
    "error_rate double, p50 double, p95 double, p99 double, anomaly_score double, summary string, vector array<float>"
)
#: One span with the attributes of its resource and the error-capable events.
SPAN = (
    "resource map<string,string>, attributes map<string,string>, kind int, status_code int, start_unix_nano long, end_unix_nano long, "
    "events array<struct<name:string,attributes:map<string,string>>>"
)
#: One metric data point; kind is sum or histogram, temporality 1 delta or 2 cumulative.
POINT = (
    "resource map<string,string>, name string, kind string, temporality int, labels map<string,string>, value double, "
    "bounds array<double>, counts array<long>, time_unix_nano long"
)
PROM_SAMPLE = "labels map<string,string>, value double, ts_ms long"
LOG_RECORD = (
    "resource string, scope_name string, scope_version string, time_unix_nano long, observed_unix_nano long, severity_text string, "
    "severity_number int, body string, trace_id binary, span_id binary, flags int, attributes string"
)
KINDS = ("metrics", "traces", "prom_rw", "json_logs")
#: The default upper bounds, in seconds, of the duration histogram.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
