"""Configurations with every option by its name, the effect of each, and the command that runs them."""

from __future__ import annotations

import http.server
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

import telemill.__main__ as command
from telemill.operators import otlp_logs
from telemill.plans import config, pipeline
from telemill.schema import ENVELOPE
from telemill.sources import brokers, otlp
from telemill.streaming import progress

from .test_pipeline import FOREST, text

EXAMPLE = """
receivers:
  otlpgrpc: {endpoint: ":4317", extra: {reflection: true, max_recv_msg_bytes: 16777216, tls: {enabled: true, cert_file: c}, keepalive: {time_ms: 1}}}
  otlphttp: {endpoint: ":4318", extra: {max_body_bytes: 400, read_timeout_ms: 30000, paths: {traces: /v1/traces}}}
  promrw: {endpoint: ":19291", extra: {path: /api/v1/write, max_body_bytes: 33554432}}
  jsonlogs/http: {endpoint: "0.0.0.0:19292", extra: {path: /v1/logs}}
  kafka/traces: {brokers: ["k1:9092", "k2:9092"], topic: t, group: g, kind: traces, extra: {max_bytes: 10485760}}
  pulsar/logs: {endpoint: "pulsar://p:6650", topic: "persistent://public/default/logs", group: s, kind: json_logs, extra: {ndjson: true, subscription_type: key-shared, receiver_queue_size: 9, message_chan_buffer: 64, auth_token_file: /t, tls_trust_certs_file: /c, tls_allow_insecure: true}}
processors:
  filter/pre: {stage: pre, on: metrics, drop_non_matching: true, expr: 'attrs["env"] == "prod"'}
  filter/post: {stage: post, on: aggregates, drop_non_matching: true, expr: 'count > 0.0'}
  spanmetrics: {dimensions: [service.name, http.route], histogram_buckets: [0.01, 0.1], error_from_status: false, error_from_events: true, error_event_names: [Oops], error_event_attr_dims: [why], max_error_attr_values: 1000}
  otlplogs: {resource_attrs: true, scope_attrs: true, attr_prefix: "", resource_prefix: "resource.", scope_prefix: "scope.", level_alias: level, service_key: service.name}
  logsum: {window_seconds: 60, service_field: service, level_field: level, error_levels: [warn], user_id_fields: [who], topk_fields: [endpoint, operation], topk_limit: 1, quantile_field: ms, reservoir_cap: 256}
  summarizer: {window_seconds: 60, service_attribute: service.name, bucket_sample_cap: 50}
  iforest: {features: [p99, error_rate, rps], threshold: 0.7, normalization: zscore, baseline_window: 3600, subsample_size: 64, model_path: "${FOREST_PATH}"}
  vectorizer:
    mode: hash
    endpoint: http://o:1
    model: m
    allow_fallback: true
    timeout_ms: 5000
    retries: 0
    hash_dim: 24
    hash_ngrams: 2
    lowercase: true
    stopwords: [the, a]
    logs: {include_fields: [org_id, success, error_code]}
    metrics: {p90_approx: true, ema_alpha: 0.3, pca: {enabled: false}}
    traces: {include_span_attrs: [http.method], max_attrs: 6}
exporters:
  weaviate: {endpoint: "http://w:8080", class: C, api_key: "${NO_SUCH_KEY}"}
  parquet/out: {path: OUT, insert_if_absent: true, id_template: "{{.Service}}:{{.WindowStart}}:{{.Labels.source}}"}
service:
  pipelines:
    traces: {receivers: [otlpgrpc, otlphttp], processors: [spanmetrics, summarizer, iforest, vectorizer], exporters: [parquet/out]}
    logs: {receivers: [otlpgrpc, jsonlogs/http], processors: [otlplogs, logsum, filter/post, vectorizer], exporters: [parquet/out]}
extensions: {health_check: {endpoint: "0.0.0.0:13133"}}
"""


def traces(route, events=(), size=0):
    span = {"name": "x" * size, "kind": 2, "start": 10**9, "end": 10**9 + 5 * 10**7, "attributes": [text("http.route", route)], "status": {"code": 2}, "events": list(events)}
    return otlp.encode("Traces", {"resource_spans": [{"resource": {"attributes": [text("service.name", "web")]}, "scope_spans": [{"spans": [span]}]}]})


def land(spark, root, component, rows):
    spark.createDataFrame([(k, bytearray(b), {}, t) for k, b, t in rows], ENVELOPE).coalesce(1).write.mode("append").parquet(f"{root}/{component}")


def test_example_runs_as_it_stands(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "landing", tmp_path / "out"
    (tmp_path / "forest.json").write_text(json.dumps(FOREST))
    monkeypatch.setenv("FOREST_PATH", str(tmp_path / "forest.json"))
    oops = {"name": "oops", "attributes": [text("why", "full")]}
    land(spark, root, "otlpgrpc", [("traces", traces("/a", [oops]), 1), ("traces", traces("/a"), 1)])
    land(spark, root, "otlphttp", [("traces", traces("/b", size=500), 1), ("traces", traces("/b"), 1)])  # the first is too large
    (root / "jsonlogs_http").mkdir(parents=True)
    lines = [{"service": "app", "level": "WARN", "who": "u1", "endpoint": "/x", "operation": "o", "ms": 4, "ts": 5}, {"service": "app", "level": "error", "who": "u2", "endpoint": "/x", "ms": 8, "ts": 6}, {"service": "app", "user_id": "u3", "endpoint": "/y", "ts": 7}]
    (root / "jsonlogs_http" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n\nbroken\n")
    (tmp_path / "c.yaml").write_text(EXAMPLE.replace("OUT", str(out)))
    for _ in range(2):  # a repeated run inserts nothing twice
        for p in pipeline.build(config.load(str(tmp_path / "c.yaml")), str(root)).values():
            p.run_batch(p.source(spark))
    got = {r["id"]: r for r in spark.read.option("mergeSchema", "true").parquet(str(out)).collect()}
    assert sorted(got) == ["app:0:logs", "web:0:traces"] and spark.read.parquet(str(out)).count() == 2
    web, app = got["web:0:traces"], got["app:0:logs"]
    # three spans of ok kind or not: status is no error here, the event is; bounds 0.01 and 0.1
    assert (web["count"], web["p50"], len(web["vector"])) == (3 + 1 + 3, 0.1, 24) and web["error_rate"] == pytest.approx((3 + 1) / (3 + 1))
    assert (app["count"], app["error_rate"], app["p50"], app["labels"]["unique_users"]) == (3, pytest.approx(1 / 3), 6.0, "2")
    assert app["labels"]["top_endpoint"] == "/x:2" and app["labels"]["top_operation"] == "o:1" and app["summary"].endswith(" top_endpoint=/x:2")


def test_unknown_options_and_components_are_errors():
    for raw in ({"processors": {"logsum": {"top_k": 3}}}, {"receivers": {"kafka": {"topics": ["t"]}}}, {"processors": {"vectorizer": {"metrics": {"alpha": 1}}}}, {"exporters": {"weaviate": {"url": "u"}}}):
        with pytest.raises(config.ConfigError, match="unknown option"):
            config.from_dict(raw)
    with pytest.raises(config.ConfigError, match="unknown receiver"):
        pipeline.build(config.from_dict({"receivers": {"carrier": {}}}))


def test_flattening_options(spark):
    record = otlp.encode("Logs", {"resource_logs": [{"resource": {"attributes": [text("service.name", "a"), text("app.id", "b")]}, "scope_logs": [{"scope": {"name": "s"}, "records": [{"time": 10**9, "attributes": [text("k", "v")]}]}]}]})
    rows = otlp.decode_bodies(spark.createDataFrame([(bytearray(record),)], "bytes binary"), "bytes", "logs")
    fields = lambda **o: otlp_logs.flatten(rows, **o).first()["fields"]
    assert fields() == {"timestamp_unix_nano": "1000000000", "k": "v", "resource.service.name": "a", "resource.app.id": "b", "service": "a", "service.name": "a", "scope.name": "s"}
    assert fields(resource_attrs=False, scope_attrs=False, attribute_prefix="x.") == {"timestamp_unix_nano": "1000000000", "x.k": "v"}
    assert fields(service_attribute="app.id", resource_prefix="r_", scope_prefix="s_") == {"timestamp_unix_nano": "1000000000", "k": "v", "r_service.name": "a", "r_app.id": "b", "service": "b", "service.name": "b", "s_name": "s"}


def test_broker_options():
    c = config.from_dict({"receivers": {"pulsar/x": {"endpoint": "pulsar://p", "topic": "t", "group": "s", "extra": {"auth_token_file": "/t", "tls_allow_insecure": True}}}}).receivers["pulsar/x"]
    assert c.get("auth_token_file") == "/t"
    made = brokers.pulsar_options("pulsar://p", "t", "s", "keyshared", None, "/c", "/t", True, 9)
    assert made["subscriptionType"] == "Key_Shared" and made["pulsar.client.authParams"] == "file:///t" and made["pulsar.client.tlsAllowInsecureConnection"] == "true" and made["failOnDataLoss"] == "true"
    assert brokers.kafka_options(["a"], "t")["failOnDataLoss"] == "true" and brokers.kafka_options(["a"], "t", fail_on_data_loss=False)["failOnDataLoss"] == "false"
    with pytest.raises(ValueError):
        brokers.pulsar_options("", "t", "s")


def test_bodies_without_spans_go_on(spark):
    cfg = config.from_dict({"processors": {"spanmetrics": {}}})
    empty = otlp.encode("Traces", {"resource_spans": [{"resource": {"attributes": []}, "scope_spans": []}]})
    rows = spark.createDataFrame([("traces", bytearray(b), {"a": "b"}, t) for b, t in ((empty, 1), (b"\xff", 2), (traces("/a"), 3))], ENVELOPE)
    flow = pipeline.PROCESSORS["spanmetrics"](cfg.processors["spanmetrics"])(pipeline.Flow.of(rows))
    passed = flow.kinds["traces"].collect()
    assert {(bytes(r["bytes"]), r["ts_unix"], r["attrs"]["a"]) for r in passed} == {(empty, 1, "b"), (b"\xff", 2, "b")}
    assert {r["name"] for r in flow.points.collect()} == {"requests_total", "errors_total", "duration_seconds"}


class Embedder(http.server.BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.calls.append((self.path, body["model"]))
        good = "service=bad" not in body["prompt"]
        self.send_response(200 if good else 500)
        self.end_headers()
        self.wfile.write(json.dumps({"embedding": [3.0, 4.0] if good else []}).encode())

    def log_message(self, *a):
        pass


def test_remote_embedding_with_retries_and_fallback(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Embedder)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"service": s, "ts": 5}) for s in ("good", "bad")) + "\n")
        vectors = {}
        for fallback in (True, False):
            raw = {"receivers": {"jsonlogs": {"path": str(tmp_path / "in")}}, "processors": {"logsum": {}, "vectorizer": {"mode": "remote", "endpoint": f"http://127.0.0.1:{server.server_port}", "model": "m", "retries": 1, "allow_fallback": fallback, "hash_dim": 8}}, "pipelines": {"p": {"receivers": ["jsonlogs"], "processors": ["logsum", "vectorizer"]}}}
            made = pipeline.build(config.from_dict(raw))["p"]
            vectors[fallback] = {r["service"]: r["vector"] for r in made.aggregates(made.source(spark)).collect()}
        assert vectors[True]["good"] == pytest.approx([0.6, 0.8]) and len(vectors[True]["bad"]) == 8
        assert vectors[False]["bad"] is None and ("/api/embeddings", "m") in Embedder.calls
        assert len(Embedder.calls) >= 6  # a text that fails is tried twice
    finally:
        server.shutdown()


def test_command_runs_a_configuration(spark, tmp_path, monkeypatch):
    (tmp_path / "landing" / "jsonlogs").mkdir(parents=True)
    (tmp_path / "landing" / "jsonlogs" / "a.json").write_text('{"service":"a","ts":5}\n{"service":"a","ts":65}\n')
    (tmp_path / "c.yaml").write_text(f"receivers: {{jsonlogs: {{endpoint: x}}}}\nprocessors: {{logsum: }}\nexporters: {{parquet: {{path: {tmp_path}/out}}}}\npipelines: {{p: {{receivers: [jsonlogs], processors: [logsum], exporters: [parquet]}}}}\n")
    monkeypatch.setattr(command, "build_session", lambda *a: spark)
    seen = {}
    monkeypatch.setattr(command, "serve", lambda counters, address: seen.setdefault("server", progress.serve(counters, address)))
    base = ["--config", str(tmp_path / "c.yaml"), "--landing", str(tmp_path / "landing")]
    assert command.main([*base, "--metrics-addr", "127.0.0.1:0"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("count") == 1).count() == 2
    assert command.main([*base, "--stream", "--checkpoint", str(tmp_path / "cp")]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    with pytest.raises(config.ConfigError):
        command.main([*base, "--pipeline", "q"])


def test_endpoints():
    counters = progress.ProgressCounters()
    server = progress.serve(counters, "127.0.0.1:0")
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read().decode()
    try:
        assert get("/livez") == "ok"
        with pytest.raises(urllib.error.HTTPError):
            get("/readyz")
        with counters.batch("p"):
            pass
        assert get("/readyz") == "ready" and 'telemill_ended{query="p"} 1' in get("/metrics")
        with pytest.raises(ZeroDivisionError), counters.batch("p"):
            1 / 0
        with pytest.raises(urllib.error.HTTPError):
            get("/livez")
    finally:
        server.shutdown()
