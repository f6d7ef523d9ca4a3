"""Configuration and whole pipelines, in batch and as streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from telemill.operators import logs as log_ops
from telemill.plans import config, pipeline
from telemill.schema import ENVELOPE
from telemill.sources import otlp, views
from telemill.streaming import progress, state, windows

FOREST = {"trees": [{"nodes": [{"f": 1, "t": 0.2, "l": 1, "r": 2}, {"leaf": True}, {"f": 0, "t": 9.0, "l": 3, "r": 4}, {"leaf": True}, {"leaf": True}]}]}


def raw_config(tmp_path, out):
    return {
        "receivers": {"landing/in": {"path": str(tmp_path), "extra": {"max_files_per_trigger": 1}}},
        "processors": {
            "filter/env": {"stage": "pre", "expression": 'attrs["env"] == "prod"'}, "spanmetrics": {"dimensions": ["http.route"]}, "otlplogs": None, "summarizer/m": {"window_seconds": 60}, "logsum": {"window_seconds": 60, "top_fields": ["endpoint"]},
            "iforest": {"model": FOREST, "features": ["p99", "error_rate"], "threshold": 0.5}, "filter/post": {"stage": "post", "expression": "count > 0"}, "vectorizer": {"hash_dim": 32},
        },
        "exporters": {"parquet/out": {"path": str(out)}, "noop": {}},
        "service": {"pipelines": {"all": {"receivers": ["landing/in"], "processors": ["filter/env", "spanmetrics", "otlplogs", "summarizer/m", "logsum", "filter/post", "vectorizer"], "exporters": ["parquet/out", "noop"]}}},
        "extensions": {"health": {}},
    }


def test_config(tmp_path):
    cfg = config.from_dict(raw_config(tmp_path, "x"))
    c = cfg.receivers["landing/in"]
    assert (c.type, c.name, c.get("max_files_per_trigger", 5, int), c.get("nothing", 7), c.key) == ("landing", "in", 1, 7, "landing/in")
    assert cfg.pipelines["all"].exporters == ("parquet/out", "noop")
    path = tmp_path / "c.yaml"
    path.write_text("receivers: {kafka/a: {topic: t}}\nprocessors: {logsum: }\npipelines: {p: {receivers: [kafka/a], processors: [logsum], exporters: []}}\n")
    assert config.load(str(path)).pipelines["p"].receivers == ("kafka/a",)
    with pytest.raises(config.ConfigError):
        config.from_dict({"pipelines": {"p": {"receivers": ["none"]}}})
    with pytest.raises(config.ConfigError):
        pipeline.build(config.from_dict({"processors": {"mystery": {}}}))


def text(k, v):
    return {"key": k, "value": {"string": v}}


def envelopes(spark):
    resource = {"attributes": [text("service.name", "web")]}
    span = lambda code, ms: {"kind": 2, "start": 10**9, "end": 10**9 + ms * 10**6, "attributes": [text("http.route", "/x")], "status": {"code": code}}
    traces = otlp.encode("Traces", {"resource_spans": [{"resource": resource, "scope_spans": [{"spans": [span(0, 4), span(2, 80)]}]}]})
    metric = otlp.encode("Metrics", {"resource_metrics": [{"resource": {"attributes": [text("service.name", "db")]}, "scope_metrics": [{"metrics": [{"name": "requests_total", "sum": {"temporality": 1, "points": [{"time": 10**9, "as_int": 60, "attributes": []}]}}]}]}]})
    prom = otlp.encode("WriteRequest", {"timeseries": [{"labels": [{"name": "__name__", "value": "http_requests_total"}, {"name": "job", "value": "cron"}], "samples": [{"value": 6.0, "timestamp": 1000}]}]})
    record = otlp.encode("Logs", {"resource_logs": [{"resource": {"attributes": [text("service.name", "app")]}, "scope_logs": [{"records": [{"time": 10**9, "severity_text": "ERROR", "body": {"string": "boom"}, "attributes": [text("endpoint", "/pay")]}]}]}]})
    line = json.dumps({"service": "app", "level": "info", "user_id": "u1", "endpoint": "/pay", "latency_ms": "12.5", "ts": 2}).encode()
    rows = [("traces", traces, {}, 1), ("metrics", metric, {"env": "prod"}, 1), ("prom_rw", prom, {}, 1), ("json_logs", record, {}, 1), ("json_logs", line, {}, 2), ("json_logs", b"broken", {}, 2), ("metrics", metric, {"env": "dev"}, 1), ("traces", b"\xff", {}, 1)]
    return spark.createDataFrame([(k, bytearray(b), a, t) for k, b, a, t in rows], ENVELOPE)


def test_batch_pipeline(spark, tmp_path):
    out = tmp_path / "out"
    made = pipeline.build(config.from_dict(raw_config(tmp_path / "in", out)))["all"]
    made.run_batch(envelopes(spark))
    got = {(r["service"], r["labels"]["source"]): r for r in spark.read.parquet(str(out)).collect()}
    assert set(got) == {("web", "traces"), ("db", "metrics"), ("cron", "metrics"), ("app", "logs")}
    web, app = got["web", "traces"], got["app", "logs"]
    assert (web["count"], web["rps"], web["error_rate"]) == (5, pytest.approx(3 / 60), pytest.approx(2 / 3))
    assert (app["count"], app["error_rate"], app["p50"], app["labels"]["top_endpoint"], app["labels"]["unique_users"]) == (2, 0.5, 12.5, "/pay:2", "1")
    assert len(app["vector"]) == 32 and len(got["db", "metrics"]["vector"]) == 8
    assert got["db", "metrics"]["rps"] == 1.0 and got["cron", "metrics"]["count"] == 6


def test_scores_in_a_pipeline(spark, tmp_path):
    raw = raw_config(tmp_path, tmp_path / "o")
    raw["service"]["pipelines"]["all"]["processors"] = ["logsum", "iforest"]
    rows = pipeline.build(config.from_dict(raw))["all"].aggregates(envelopes(spark)).collect()
    assert len(rows) == 1 and 0 < rows[0]["anomaly_score"] < 1 and rows[0]["is_anomaly"] is not None


def test_stream_pipeline_equals_batch(spark, tmp_path):
    source, streamed, batch = tmp_path / "in", tmp_path / "streamed", tmp_path / "batch"
    envelopes(spark).coalesce(1).write.parquet(str(source))
    made = pipeline.build(config.from_dict(raw_config(source, streamed)))["all"]
    made.run_stream(spark, str(tmp_path / "cp")).awaitTermination(120)
    pipeline.build(config.from_dict(raw_config(source, batch)))["all"].run_batch(spark.read.parquet(str(source)))
    rows = [sorted(map(str, spark.read.parquet(str(p)).drop("labels").collect())) for p in (streamed, batch)]
    assert rows[0] and rows[0] == rows[1]


def stream_of(spark, df, tmp_path, files=3):
    path = str(tmp_path / "stream")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name)


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    logs = views.logs(spark, sf).where("service IN ('basket-api', 'ledger-api')")
    totals = collect(spark, windows.log_totals(stream_of(spark, logs, tmp_path), 3600, "2 days"), "totals_out")
    batch = {(r["service"], r["window_start"]): r for r in log_ops.totals(logs, 3600).collect()}
    assert totals.count() == 0  # the watermark has closed nothing yet
    later = spark.createDataFrame([(0, 1_900_000_000 + i * 10**7, "x", "info", "u", "/", "op", 1.0) for i in range(2)], logs.schema)
    mixed = logs.withColumn("part", F.lit(0)).unionAll(later.withColumn("part", F.lit(1)))
    path = str(tmp_path / "two")
    mixed.where("part = 0").drop("part").coalesce(1).write.mode("append").parquet(path)
    mixed.where("part = 1").drop("part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(logs.schema).parquet(path)
    got = {(r["service"], r["window_start"]): r for r in collect(spark, windows.log_totals(stream, 3600, "1 hour"), "totals_two").collect() if r["service"] != "x"}
    assert set(got) == set(batch)
    for k, r in got.items():
        assert (r["count"], r["unique_users"]) == (batch[k]["count"], batch[k]["unique_users"]) and r["p95"] == pytest.approx(batch[k]["p95"]) and r["error_rate"] == pytest.approx(batch[k]["error_rate"])
    tops = {(r["service"], r["window_start"]): r["top"] for r in collect(spark, windows.top_k(stream, 3600, "1 hour", "operation", 3), "tops_two").collect() if r["service"] != "x"}
    assert tops and tops == {k: v for k, v in ((((r["service"], r["window_start"])), r["top"]) for r in log_ops.top_k(logs, 3600, "operation", 3).collect()) if k in tops}


def test_state_carries_over_batches(spark, tmp_path):
    rows = [("a", t, v) for t, v in enumerate([5.0, 8.0, 2.0, 6.0])] + [("b", 0, 1.0)]
    path = tmp_path / "s"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "series string, t long, v double").coalesce(1).write.mode("append").parquet(str(path))
        import os
        import time

        newest = max((p for p in path.iterdir() if p.suffix == ".parquet"), key=os.path.getmtime)
        os.utime(newest, (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema("series string, t long, v double").option("maxFilesPerTrigger", 1).parquet(str(path))
    delta = collect(spark, state.counter_delta(stream, "series", ["t"], "v"), "delta_out")
    assert {(r["series"], r["t"]): r["delta"] for r in delta.collect()} == {("a", 0): 5, ("a", 1): 3, ("a", 2): 0, ("a", 3): 4, ("b", 0): 1}
    ema = collect(spark, state.exponential_average(stream.where("series = 'a'"), "series", ["t"], "v", 0.5), "ema_out")
    assert [r["ema"] for r in ema.orderBy("t").collect()] == [2.5, 5.25, 3.625, 4.8125]
    z = collect(spark, state.running_zscore(stream.where("series = 'a'"), "series", ["t"], "v"), "z_out")
    assert [r["z"] for r in z.orderBy("t").collect()][:2] == [0.0, pytest.approx(0.7071067811865475)]


def test_insert_once_and_corrections(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 10, "a"), ("x", 2, 20, "a"), ("y", 3, 310, "a")], "id string, n int, event long, service string").withColumn("at", F.timestamp_seconds("event"))
    stream = stream_of(spark, rows.coalesce(1), tmp_path, 1)
    assert collect(spark, windows.insert_once(stream, "id", "at", "1 hour").select("id"), "once_out").count() == 2
    got = collect(spark, windows.late_corrections(stream, 300, "1 hour"), "late_out", "update").collect()
    assert {(r["window_start"], r["records"]) for r in got} == {(0, 2), (300, 1)}


def test_progress_counters(spark, tmp_path):
    counters = progress.ProgressCounters()
    spark.streams.addListener(counters)
    try:
        rows = spark.createDataFrame([(1,), (2,)], "a int")
        collect(spark, progress.observed(stream_of(spark, rows, tmp_path, 1), "seen"), "counted_out")
        import time

        for _ in range(50):
            if counters.queries.get("counted_out", {}).get("ended"):
                break
            time.sleep(0.2)
        assert counters.queries["counted_out"]["rows"] == 2 and counters.live()
    finally:
        spark.streams.removeListener(counters)
