"""Formulas of the telemetry operators on hand-computed rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from telemill.functions.columns import percentiles, plain_number, trimmed_number
from telemill.operators import forest, logs, metrics, otlp_logs, series, spans, vectors
from telemill.schema import POINT, SPAN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_log_percentiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (40.0,), (100.0,)], "v double")
    assert df.agg(*percentiles(F.col("v"), (0.5, 0.95, 0.99))).first()[:] == pytest.approx((30.0, 91.0, 98.2))


def test_forest_constants(spark):
    assert forest.mean_path(256) == pytest.approx(10.244770920119917)
    assert forest.mean_path(1) == forest.mean_path(256)
    assert math.exp(-3 / forest.mean_path(256)) == pytest.approx(0.7461472468297694)


def test_forest_walks(spark):
    x = [F.lit(0.2), F.lit(5.0)]
    leaf = {"leaf": True, "size": 3}
    trees = {
        "plain": ([[{"f": 0, "t": 0.15, "l": 1, "r": 2}, leaf, leaf]], 1),
        "cycle": ([[{"f": 1, "t": 1.0, "l": 0, "r": 0, "leaf": False}, leaf]], 64),
        "bad child": ([[{"f": 1, "t": 1.0, "l": 9, "r": 9}]], 1),
        "bad feature": ([[{"f": 7, "t": -1.0, "l": 1, "r": 2}, leaf, {"f": 0, "t": 1.0, "l": 3, "r": 3}, leaf]], 2),
    }
    for name, (model, depth) in trees.items():
        want = math.exp(-depth / forest.mean_path(256))
        assert one(spark, forest.score(x, model)) == pytest.approx(want), name
        assert one(spark, forest.score(x, model, compile_limit=0)) == pytest.approx(want), name
    assert one(spark, forest.score(x, [])) == 0.0


def test_forest_loading(tmp_path):
    model = '{"trees":[{"nodes":[{"leaf":true}]}]}'
    path = tmp_path / "m.json"
    path.write_text(model)
    want = [[{"leaf": True}]]
    for options in ({"model_path": str(path)}, {"model": model}, {"model": {"path": str(path)}}, {"model_inline": model}, {"model_path": "/nowhere", "model": model}):
        assert forest.load_model(options) == want
    assert forest.load_model({"model": "not a model"}) == forest.load_model({}) == []


def test_zscore_and_average(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 90_000, 2.0), ("a", 200_000, 4.0)], "service string, t long, v double")
    z = series.running_zscore(df, "service", ["t"], ["v"]).orderBy("t").collect()
    assert [r["z_v"] for r in z] == pytest.approx([0, 0.7071067811865475, 1.0910894511799618])
    e = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 3.0), ("a", 200_000, 5.0)], "service string, t long, v double")
    assert [r["ema_v"] for r in series.exponential_average(e, "service", ["t"], ["v"], 0.3).orderBy("t").collect()] == pytest.approx([0.3, 1.11, 2.277])
    assert [r["ema_v"] for r in series.exponential_average(e, "service", ["t"], ["v"], 1.0).orderBy("t").collect()] == [1.0, 3.0, 5.0]


def test_counter_delta(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5.0, 8.0, 2.0, 6.0])], "series string, t long, v double")
    assert [r["delta"] for r in metrics.counter_delta(df, "series", ["t"], "v").orderBy("t").collect()] == [5, 3, 0, 4]


def test_bucket_index(spark):
    assert [one(spark, spans.bucket_index(F.lit(v))) for v in (0.005, 0.0051, 11.0, float("nan"))] == [0, 1, 11, 0]


def test_ok_status(spark):
    got = [one(spark, metrics.is_ok(F.lit(c))) for c in ("OK", "UNSET", "2xx", "204", "299", "404", "error")]
    assert got == [True] * 5 + [False] * 2


def test_histogram_samples_are_capped(spark):
    row = ({"service.name": "a"}, "any", "histogram", 1, {}, None, [0.1, 1.0], [70, 2, 9], 5_000_000_000)
    got = metrics.summarize_points(spark.createDataFrame([row], POINT)).first()
    assert got["count"] == 52 and got["p50"] == 0.1 and got["rps"] == 0 and got["error_rate"] == 0


def test_error_span_counts_twice(spark):
    span = ({"service.name": "a"}, {}, 2, 2, 1_000_000_000, 1_200_000_000, [])
    got = metrics.summarize_points(spans.to_points(spark.createDataFrame([span], SPAN))).first()
    assert (got["rps"], got["error_rate"], got["count"]) == (pytest.approx(2 / 60), 1.0, 3)


def test_service_without_metrics_gives_zero_row(spark):
    row = ({}, "gauge", "other", 0, {}, None, None, None, 7_000_000_000)
    got = metrics.summarize_points(spark.createDataFrame([row], POINT)).first()
    assert (got["service"], got["count"], got["rps"], got["error_rate"], got["p99"]) == ("unknown", 0, 0.0, 0.0, 0.0)


def test_summary_text(spark):
    rows = [({"service.name": "a"}, "requests_total", "sum", 1, {}, 30.0, None, None, 0)]
    assert metrics.summarize_points(spark.createDataFrame(rows, POINT)).first()["summary"] == "summary service=a rps=0.500000 error_rate=0.000000 count=30"


def test_numbers_as_text(spark):
    assert [one(spark, trimmed_number(F.lit(v))) for v in (100.0, 0.0, 1.25)] == ["100", "0", "1.25"]
    assert [one(spark, plain_number(F.lit(v))) for v in (12345678.5, 1.0, 0.25, 1e15)] == ["12345678.5", "1", "0.25", "1000000000000000"]


def test_scalar_attributes(spark):
    got = one(spark, otlp_logs.scalar_attributes(F.lit('{"a":100.0,"b":true,"c":"x","d":[1],"e":null,"f":1.25}')))
    assert got == {"a": "100", "b": "true", "c": "x", "f": "1.25"}


def test_service_of_logs(spark):
    cases = {'{"service":"a"}': "a", '{"service":7}': "7", '{"service":"","svc":"b"}': "unknown", '{"service":true,"app":"c"}': "c", '{"service":{"x":1},"service.name":"d"}': "d", "{}": "unknown", '{"service":1.50}': "1.5"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", logs.service_of(logs.parse_object(F.col("t"))).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases


def test_tokens_and_hash(spark):
    assert one(spark, vectors.tokens(F.lit("Étion DANS, x"))) == ["tion", "dans", "x"]
    for term, (index, sign) in {"checkout": (345, 1), "error": (305, 1), "checkout_error": (84, -1)}.items():
        assert vectors.fnv1a64(term.encode()) % 384 == index
        assert (-1 if vectors.fnv1_64(b"sign:" + term.encode()) & 1 else 1) == sign
    grams = one(spark, vectors.ngrams(vectors.tokens(F.lit("checkout the error rate")), 3, ["the"]))
    assert grams == ["checkout", "error", "rate", "error_rate"]
    v = one(spark, vectors.hash_embedding(F.lit("checkout error")))
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-6) and v[345] > 0 > v[84]
    assert set(one(spark, vectors.hash_embedding(F.lit("")))) == {0.0}


def test_dimensions_and_error_labels(spark):
    events = [{"name": "other", "attributes": {"exception.type": "no"}}, {"name": "EXCEPTION", "attributes": {}}, {"name": "exception", "attributes": {"exception.type": "E1"}}]
    span = ({"service.name": "a", "zone": "z"}, {"http.route": "/x", "zone": ""}, 3, 0, 5, 3, events)
    df = spark.createDataFrame([span], SPAN)
    assert df.select(spans.dimensions(["http.route", "zone", "none"]).alias("d")).first()["d"] == {"span.kind": "client", "status.code": "unset", "http.route": "/x", "zone": "z", "service.name": "a"}
    assert df.select(spans.error_labels(["exception"], ["exception.type"]).alias("d")).first()["d"] == {"exception.type": "E1"}
    assert df.select(spans.is_error().alias("e"), spans.duration_seconds(F.col("start_unix_nano"), F.col("end_unix_nano")).alias("d")).first()[:] == (True, 0.0)
