"""Streamed pipelines over several micro-batches: windows, series and running figures that are split between them."""

from __future__ import annotations

import json
import os
import time

import pytest

from telemill.plans import config, pipeline
from telemill.schema import ENVELOPE
from telemill.sources import otlp
from telemill.streaming.held import Held

from .test_pipeline import FOREST, text


def add_file(spark, path, number, rows):
    """One landing file a call; the file source takes them in order of their times."""
    df = spark.createDataFrame([(k, bytearray(b), {}, t) for k, b, t in rows], ENVELOPE)
    df.coalesce(1).write.mode("append").parquet(str(path))
    newest = max((p for p in path.iterdir() if p.suffix == ".parquet"), key=os.path.getmtime)
    os.utime(newest, (time.time() - 1000 + number, time.time() - 1000 + number))


def line(ts, user, latency, endpoint="/a"):
    return "json_logs", json.dumps({"service": "app", "level": "info", "user_id": user, "endpoint": endpoint, "latency_ms": latency, "ts": ts}).encode(), ts


def total(ts, value):
    """A cumulative counter."""
    points = [{"time": ts * 10**9, "as_int": value, "attributes": []}]
    return "metrics", otlp.encode("Metrics", {"resource_metrics": [{"resource": {"attributes": [text("service.name", "db")]}, "scope_metrics": [{"metrics": [{"name": "requests_total", "sum": {"temporality": 2, "points": points}}]}]}]}), ts


# The windows 0, 60 and 120 are split over the files; the points of the counter come out of order in the last two.
FILES = [
    [line(5, "u1", 10), line(20, "u2", 30), total(10, 100), total(50, 130)],
    [line(50, "u1", 80, "/b"), line(70, "u3", 5), total(110, 190)],
    [line(100, "u4", 7), line(130, "u1", 9), total(130, 205), total(80, 160)],
]


def config_of(source, out):
    return config.from_dict({
        "receivers": {"landing/in": {"path": str(source), "extra": {"max_files_per_trigger": 1}}},
        "processors": {
            "summarizer": {"window_seconds": 60}, "logsum": {"window_seconds": 60, "top_fields": ["endpoint"]},
            "iforest": {"model": FOREST, "features": ["p99", "rps"], "normalization": "zscore"}, "vectorizer": {"hash_dim": 16, "ema_alpha": 0.5},
        },
        "exporters": {"parquet/out": {"path": str(out)}},
        "service": {"pipelines": {"all": {"receivers": ["landing/in"], "processors": ["summarizer", "logsum", "iforest", "vectorizer"], "exporters": ["parquet/out"]}}},
    })


def figures(spark, path):
    rows = spark.read.parquet(str(path)).collect()
    keys = [(r["service"], r["window_start"]) for r in rows]
    assert len(keys) == len(set(keys))  # no window in parts
    return {k: ([r["count"], sorted(r["labels"].items())], [*[r[c] for c in ("rps", "error_rate", "p50", "p95", "p99", "anomaly_score")], *r["vector"]]) for k, r in zip(keys, rows)}


def test_stream_over_three_batches_equals_batch(spark, tmp_path):
    source, streamed, batch = tmp_path / "in", tmp_path / "streamed", tmp_path / "batch"
    source.mkdir()
    for n, rows in enumerate(FILES):
        add_file(spark, source, n, rows)
    made = pipeline.build(config_of(source, batch))["all"]
    made.run_batch(spark.read.parquet(str(source)))
    want = figures(spark, batch)
    assert want["app", 0][0][0] == 3 and want["db", 0][0][0] == 130 and want["db", 60][0][0] == 60 and want["db", 120][0][0] == 15
    run = pipeline.build(config_of(source, streamed))["all"].run_stream(spark, str(tmp_path / "cp"), lateness_seconds=30)
    assert run.awaitTermination(240) and len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    got = figures(spark, streamed)
    assert set(got) == set(want)
    for k, (exact, near) in got.items():
        assert exact == want[k][0] and near == pytest.approx(want[k][1], abs=1e-6)
    state = Held(spark, str(tmp_path / "cp"), None, 0.0)
    assert sum(state.late_rows().values()) == 0


def test_state_is_held_between_runs(spark, tmp_path):
    source, out, cp = tmp_path / "in", tmp_path / "out", str(tmp_path / "cp")
    source.mkdir()
    made = pipeline.build(config_of(source, out))["all"]
    for n, rows in enumerate(FILES):
        add_file(spark, source, n, rows)
        made.run_stream(spark, cp, {"availableNow": True}, lateness_seconds=30).awaitTermination(120)
    before = figures(spark, out)
    assert before["app", 0][0][0] == 3 and ("app", 120) not in before
    made.close_windows(spark, cp)
    after = figures(spark, out)
    assert after["app", 120][0][0] == 1 and after["db", 120][0][0] == 15
    add_file(spark, source, 9, [line(1, "u9", 1), line(300, "u9", 1)])
    made.run_stream(spark, cp).awaitTermination(120)
    last = figures(spark, out)
    assert last["app", 0] == after["app", 0] and last["app", 300][0][0] == 1
    assert Held(spark, cp, None, 0.0).late_rows()["logsum"] == 1
