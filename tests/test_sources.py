"""Framing, codecs, wire format, brokers and sinks."""

from __future__ import annotations

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.sinks import stores
from telemill.sources import brokers, codecs, landing, otlp


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_snappy_round_trip(data):
    assert codecs.snappy_block_decode(codecs.snappy_block_encode(data)) == data
    twice = data * 3  # copies of what came before
    for block in (codecs.snappy_block_encode(twice), codecs.snappy_literals(twice)):
        assert codecs.snappy_block_decode(block) == codecs._snappy_decode(block) == twice


def test_snappy_copies_and_errors():
    assert codecs.snappy_block_decode(bytes([11, 4 << 0, 97, 98])[:1] + bytes([0, 97]) + bytes([(10 - 1) << 2 | 2, 1, 0])) == b"a" * 11
    for bad in (b"", b"\x05\x00", b"\x05\x09\x05\x00", b"\xff" * 9):
        with pytest.raises(ValueError):
            codecs.snappy_block_decode(bad)


def test_decode_body(spark):
    plain = b"hello hello"
    rows = [(gzip.compress(plain), "gzip"), (codecs.snappy_block_encode(plain), "SNAPPY"), (gzip.compress(plain), None), (plain, "identity"), (b"no gzip", "gzip"), (None, "gzip"), (plain, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, e) for i, (b, e) in enumerate(rows)], "i int, b binary, e string")
    got = {r["i"]: r["x"] and bytes(r["x"]) for r in df.select("i", codecs.decode_body(F.col("b"), F.col("e")).alias("x")).collect()}
    assert got == {0: plain, 1: plain, 2: plain, 3: plain, 4: None, 5: None, 6: plain}


_any = st.recursive(
    st.one_of(st.builds(lambda x: {"string": x}, st.text(max_size=6)), st.builds(lambda x: {"bool": x}, st.booleans()), st.builds(lambda x: {"int": x}, st.integers(-(2**63), 2**63 - 1)), st.builds(lambda x: {"double": x}, st.floats(allow_nan=False)), st.builds(lambda x: {"bytes": x}, st.binary(max_size=4))),
    lambda v: st.one_of(st.builds(lambda x: {"array": {"values": x}}, st.lists(v, min_size=1, max_size=3)), st.builds(lambda x: {"kvlist": {"values": x}}, st.lists(st.builds(lambda k, y: {"key": k, "value": y}, st.text(min_size=1, max_size=3), v), min_size=1, max_size=3))),
    max_leaves=5,
)


@settings(max_examples=80, deadline=None)
@given(_any)
def test_wire_round_trip(value):
    assert otlp.decode("AnyValue", otlp.encode("AnyValue", value)) == value
    json.dumps(otlp.any_json(value))


def test_broken_bodies_are_wire_errors():
    """Changed and cut bodies decode or raise WireError; a number that comes as fixed bytes is such an error."""
    import random

    r = random.Random(5)
    span = {"kind": 2, "start": 1, "end": 300, "attributes": [{"key": "a", "value": {"int": -5}}], "status": {"code": 2}}
    body = otlp.encode("Traces", {"resource_spans": [{"scope_spans": [{"spans": [span, span]}]}]})
    for _ in range(4000):
        x = bytearray(body[: r.randrange(1, len(body) + 1)])
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = r.randrange(256)
        try:
            otlp.decode(r.choice(["Traces", "Logs", "Metrics", "AnyValue", "Span"]), bytes(x))
        except otlp.WireError:
            pass
    with pytest.raises(otlp.WireError):
        otlp.decode("Span", bytes([6 << 3 | 5, 1, 0, 0, 0]))


def test_json_is_no_protobuf():
    for text in (b'{"resourceLogs":[]}', b'{"a":1}', b"[1,2]", b"plain text"):
        with pytest.raises(otlp.WireError):
            otlp.decode("Logs", text)


def test_any_values_as_json():
    v = {"kvlist": {"values": [{"key": "a", "value": {"int": 3}}, {"key": "b", "value": {"bytes": b"\xab"}}, {"key": "c", "value": {"array": {"values": [{"bool": True}, {}]}}}]}}
    assert otlp.any_json(v) == {"a": 3.0, "b": "ab", "c": [True, None]}


def test_decoded_rows_and_broken_bodies(spark):
    metric = {"resource_metrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"string": "a"}}, {"key": "n", "value": {"int": 1}}]}, "scope_metrics": [{"metrics": [{"name": "g", "gauge": {"points": [{"time": 7}]}}, {"name": "s", "sum": {"temporality": 1, "points": [{"time": 9, "as_double": 1.5}]}}]}]}]}
    df = spark.createDataFrame([(bytearray(otlp.encode("Metrics", metric)),), (bytearray(b"\xff\xff"),), (None,)], "b binary")
    rows = otlp.decode_bodies(df, "b", "metrics").collect()
    assert [(r["name"], r["kind"], r["value"], r["time_unix_nano"], r["resource"]) for r in rows] == [("g", "other", None, 7, {"service.name": "a", "n": ""}), ("s", "sum", 1.5, 9, {"service.name": "a", "n": ""})]
    assert [r["x"] for r in df.select(otlp.decodable(F.col("b"), "metrics").alias("x")).collect()] == [True, False, False]


def test_lines_and_bounds(spark):
    df = spark.createDataFrame([(1, " a \r\n\n\tb\nccccc\nd"), (2, ""), (3, None)], "id int, body string")
    assert [(r["id"], r["line"]) for r in landing.split_lines(df, "body").collect()] == [(1, "a"), (1, "b"), (1, "ccccc"), (1, "d")]
    assert [r["line"] for r in landing.split_lines(df, "body", max_line=4).collect()] == ["a", "b"]
    assert [r["id"] for r in landing.within_size(df, "body", 3).collect()] == [2]


def test_headers_become_attributes(spark):
    headers = [("X-Scope-OrgID", b"o1"), ("Authorization", b"secret"), ("a", b"1"), ("a", b"2"), ("X-Prometheus-Remote-Write-Version", b"0.1.0")]
    df = spark.createDataFrame([([(k, bytearray(v)) for k, v in headers],)], "h array<struct<key:string,value:binary>>")
    assert df.select(landing.attributes(F.col("h")).alias("a")).first()["a"] == {"X-Scope-OrgID": "o1", "a": "2", "X-Prometheus-Remote-Write-Version": "0.1.0"}
    assert df.select(landing.attributes(F.col("h"), landing.PROM_HEADERS).alias("a")).first()["a"] == {"org_id": "o1", "promrw.version": "0.1.0"}


def test_broker_messages(spark):
    rows = [(bytearray(b'{"a":1}\n\n{"b":2}\n'), [("env", bytearray(b"prod"))], 5), (bytearray(b"x" * 50), None, 6)]
    df = spark.createDataFrame(rows, "value binary, headers array<struct<key:string,value:binary>>, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    got = brokers.broker_envelopes(df, F.lit("logs"), ndjson=True, max_bytes=40).collect()
    assert [(r["kind"], bytes(r["bytes"]), r["attrs"], r["ts_unix"]) for r in got] == [("json_logs", b'{"a":1}', {"env": "prod"}, 5), ("json_logs", b'{"b":2}', {"env": "prod"}, 5)]
    assert brokers.kafka_options(["a:1", "b:2"], "t", "g", max_offsets=9)["maxOffsetsPerTrigger"] == "9"
    assert brokers.pulsar_options("u", "t", "s", "key_shared", "tok")["subscriptionType"] == "Key_Shared"


def test_landing_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"service":"a"}\n\n  {"service":"b"}  \n')
    got = brokers.landing_lines(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["bytes"]) for r in got) == [b'{"service":"a"}', b'{"service":"b"}'] and all(r["ts_unix"] > 1_600_000_000 and r["kind"] == "json_logs" for r in got)


def test_object_ids(spark):
    df = spark.createDataFrame([("a", 60, {"env": "p"})], "service string, window_start long, labels map<string,string>")
    assert df.select(stores.render_id().alias("x"), stores.render_id("{{ .Labels.env }}-{{.Labels.none}}!").alias("y")).first()[:] == ("a:60", "p-!")
    with pytest.raises(ValueError):
        stores.render_id("{{.Nothing}}")


def test_insert_if_absent(spark):
    rows = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), ("y", 1, "stored"), ("z", 5, None)], "id string, n int, v string")
    got = stores.insert_if_absent(rows, spark.createDataFrame([("y",)], "id string"), "id", ["n"]).collect()
    assert {(r["id"], r["n"], r["v"]) for r in got} == {("x", 1, "first"), ("z", 5, None)}


def test_vector_store_over_http(spark):
    seen: list[dict] = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = 409 if any(x["id"] == body["id"] for x in seen) else 500 if body["id"] == "bad:0" else 200
            seen.append(body)
            self.send_response(code)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 0, [1.0, 2.0]), ("bad", 0, None)], "service string, window_start long, vector array<float>").coalesce(1)
        post = stores.http_post(f"http://127.0.0.1:{server.server_port}/v1/objects", 5)
        got = stores.push_objects(stores.vector_objects(df, "Agg"), post).agg(*[F.sum(c) for c in ("sent", "existing", "failed")]).first()
        assert got[:] == (1, 1, 1)
        assert seen[0]["class"] == "Agg" and seen[0]["vector"] == [1.0, 2.0] and seen[0]["properties"]["service"] == "a"
        lost = stores.push_objects(stores.vector_objects(df, "Agg"), stores.http_post("http://127.0.0.1:9/x", 1)).agg(F.sum("failed")).first()
        assert lost[0] == 3
    finally:
        server.shutdown()
