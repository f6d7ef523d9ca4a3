"""Late events, regular grid, drifting schemas and spikes against plain Python."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemill.operators import late_events, regular_grid, schema_drift, spikes
from telemill.plans import core_problems as P

from .oracle import DATA


@pytest.mark.parametrize("kind", ["empty", "wide", "nulls"])
@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p5_found", "p5_table", "p7_found"])
def test_odd_tables(spark, sf, variant_dirs, name, kind):
    df = P.QUERIES[name](spark, variant_dirs[kind])
    rows = df.collect()
    if kind == "empty":
        assert not rows
    if kind == "wide":
        assert sorted(map(str, rows)) == sorted(map(str, P.QUERIES[name](spark, sf).collect()))


def test_readable_seconds(spark):
    cases = {"1709510461": 1709510461, "1709510596810": 1709510596, "1709510404949000000": 1709510404, "1709510404949001": 1709510404, "2024-03-03T21:00:28-03:00": 1709510428,
             "2024-03-04T00:01:04.999Z": 1709510464, "2024-03-04 00:01:04": 1709510464, "2024-03-04T05:31:04+0530": 1709510464, "soon": None, "": None, "0": None, "-5": None, "2024": 2024}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", late_events.readable_seconds(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases


def test_triangle(spark):
    records = spark.createDataFrame([("a", 10, 20), ("a", 10, 430), ("a", 299, 700), ("a", 5, 4000), ("a", 600, 1000), ("b", 0, 300 + 119)], "service string, event long, arrival long")
    got = {(r["service"], r["window_start"], r["arrival_period"]): (r["new_records"], r["records"], r["revision"], r["is_final"]) for r in late_events.correction_triangle(records, ["service"]).collect()}
    assert got == {("a", 0, 0): (1, 1, 1, False), ("a", 0, 1): (1, 2, 2, False), ("a", 0, 3): (1, 3, 3, True), ("a", 600, 0): (1, 1, 1, True), ("b", 0, 0): (1, 1, 1, True)}


def test_grid_fills_what_it_can(spark):
    rng = np.random.default_rng(3)
    minutes, rows = 240, []
    level = 20 + 8 * np.sin(np.arange(minutes) / 30)
    truth = {}
    for s in range(6):
        for m in range(minutes):
            v = float(level[m] * (s + 1))
            if rng.random() < 0.2 and 0 < m < minutes - 1:
                truth[f"s{s}", m * 60] = v
                if m % 2:
                    rows.append((f"s{s}", m * 60 + 7, float("nan"), m))
                continue
            rows.append((f"s{s}", m * 60, v, m))
    rows += [("lone", 0, None, 1), ("lone", 86_400 * 3, 1.0, 2), ("lone", 86_400 * 3 + 120, 2.0, 3), (None, 0, 1.0, 1)]
    df = spark.createDataFrame(rows, "service string, window_start long, rps double, agg_id long")
    got = {(r["source"], r["slot_start"]): r for r in regular_grid.regular_grid(df, "service", "window_start", "rps", "agg_id").collect()}
    filled = {k: r["value"] for k, r in got.items() if r["status"] == "filled"}
    assert set(filled) == set(truth)
    assert np.median([abs(filled[k] - v) / v for k, v in truth.items()]) < 0.05
    seen = {(s, t): v for s, t, v, _ in rows if s and v == v and v is not None}
    assert all(got[k]["value"] == v for k, v in seen.items())
    assert got["lone", 86_400 * 3 + 60]["status"] == "unsupported" and got["lone", 86_400 * 3 + 60]["value"] is None
    assert got["lone", 0]["status"] == "unsupported"


def test_every_source_of_a_day_has_its_part_in_the_fill(spark):
    """More sources than a task takes: two minutes have the readings of two sources only, and a day has fewer sources than the table."""
    rng = np.random.default_rng(4)
    level = 20 + 8 * np.sin(np.arange(60) / 9)
    rows = [(f"s{s:02d}", 60 * m, float(level[m] * (1 + s)), s * 1000 + m) for s in range(70) for m in range(60) if (s in (2 * m, 2 * m + 1) if m in (30, 31) else m in (0, 59) or rng.random() < 0.8)]
    rows += [(f"s{s:02d}", 86_400 + 60 * m, float(level[m] * (1 + s)), 10**6 + s * 1000 + m) for s in (0, 1, 2) for m in range(60) if (s, m) != (0, 20)]
    df = spark.createDataFrame(rows, "service string, window_start long, rps double, agg_id long")
    grid = lambda **k: {(r["source"], r["slot_start"]): (r["status"], r["value"]) for r in regular_grid.regular_grid(df, "service", "window_start", "rps", "agg_id", **k).collect()}
    got = grid()
    seen = {(s, t): v for s, t, v, _ in rows}
    assert len(got) == 70 * 60 + 3 * 60 and all(got[k] == ("observed", v) for k, v in seen.items())
    assert all(status == "filled" for k, (status, _) in got.items() if k not in seen)
    error = [abs(got[k][1] / (level[k[1] // 60 % 1440] * (1 + int(k[0][1:]))) - 1) for k in got if k not in seen]
    assert np.median(error) < 0.05
    x = np.full((70, 1440), np.nan)
    for (s, t), v in seen.items():
        if t < 86_400:
            x[int(s[1:]), t // 60] = v
    want = regular_grid.als_fill(x, 3, 0.5, 12, 12, 2)
    for sources in (64, 7, 70):
        got = grid(block_sources=sources)
        assert all(got[k][1] == pytest.approx(want[int(k[0][1:]), k[1] // 60], rel=1e-9) for k in got if k not in seen and k[1] < 86_400)


def test_sources_that_end_in_a_zero_character_keep_their_cells(spark):
    df = spark.createDataFrame([(s, 60 * m, v + m, i * 100 + m) for i, (s, v) in enumerate([("a", 1.0), ("a\0", 50.0)]) for m in (0, 1, 3)], "service string, window_start long, rps double, agg_id long")
    got = regular_grid.regular_grid(df, "service", "window_start", "rps", "agg_id").where("status = 'observed'").collect()
    assert {(r["source"], r["slot_start"] // 60, r["value"]) for r in got} == {(s, m, v + m) for s, v in (("a", 1.0), ("a\0", 50.0)) for m in (0, 1, 3)}


def _lines(feed, file_no, objects):
    return [(feed, file_no, i, json.dumps(o) if not isinstance(o, str) else o) for i, o in enumerate(objects, 1)]


def test_drift_report_and_table(spark):
    rng = np.random.default_rng(5)
    base = lambda: {"ts": 1709532058 + int(rng.integers(1000)), "level": str(rng.choice(["info", "warn", "error"])), "user_id": str(40000 + int(rng.integers(900))), "latency_ms": round(float(rng.lognormal(3, 1)), 2)}
    one = [base() for _ in range(80)]
    two = [{("severity" if k == "level" else "uid" if k == "user_id" else k): v for k, v in base().items() if k != "latency_ms"} | {"error_code": int(rng.choice([1201, 3007]))} for _ in range(80)]
    three = [{k: (int(v) if k == "uid" else v) for k, v in x.items()} for x in two]
    lines = _lines("f", 1, one) + _lines("f", 2, [*two, "broken {", "", "[1]", {"rare": 1}]) + _lines("f", 4, three) + [(None, 1, 1, "{}")]
    df = spark.createDataFrame(lines, "feed string, file_no int, line_no int, raw string")
    change = schema_drift.changes(schema_drift.profiles(df))
    got = {(r["file_no"], r["change_kind"], r["field"], r["new_name"]) for r in change.collect()}
    assert got == {(2, "renamed", "level", "severity"), (2, "renamed", "user_id", "uid"), (2, "removed", "latency_ms", "latency_ms"), (2, "added", "error_code", "error_code"), (4, "retyped", "uid", "uid")}
    fields = [("level", "string"), ("user_id", "string"), ("latency_ms", "double"), ("ts", "long")]
    table = schema_drift.unified_table(df, schema_drift.field_names(df, change, [f for f, _ in fields]), fields)
    rows = {(r["file_no"], r["line_no"]): r for r in table.collect()}
    assert rows[1, 1]["level"] == one[0]["level"] and rows[2, 1]["level"] == two[0]["severity"]
    assert rows[4, 3]["user_id"] == str(three[2]["uid"]) and rows[4, 3]["latency_ms"] is None and rows[2, 81]["level"] is None


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in [(1, 3), (3, 2), (4, 4), (2, 5)]:
        for _ in range(20):
            s = rng.random((n, m))
            small, big = sorted((n, m))
            best = max(sum((s if n <= m else s.T)[i, p[i]] for i in range(small)) for p in permutations(range(big), small))
            got = schema_drift.assign(s)
            assert len({i for i, _ in got}) == len(got) == small
            assert sum(s[i, j] for i, j in got) == pytest.approx(best)


def test_fill_beats_the_mean_on_held_out_readings(spark):
    """Every ninth reading of real rows is hidden; the factorisation must be nearer to it than the source's own day."""
    rows = spark.read.parquet(f"{DATA}/sf0.1/aggregates.parquet").where("service IS NOT NULL AND rps > 0 AND rps < 1e6").select("agg_id", "service", "window_start", "rps").toPandas().sort_values("agg_id").drop_duplicates(["service", "window_start"])
    hidden = rows[rows["agg_id"] % 9 == 0]
    df = spark.createDataFrame(rows.assign(rps=rows["rps"].where(rows["agg_id"] % 9 != 0)))
    grid = regular_grid.regular_grid(df, "service", "window_start", "rps", "agg_id").where("status = 'filled'").toPandas()
    hidden = hidden.assign(slot_start=hidden["window_start"] // 60 * 60)
    both = hidden.merge(grid, left_on=["service", "slot_start"], right_on=["source", "slot_start"])
    rest = rows[rows["agg_id"] % 9 != 0]
    mean = rest.assign(l=np.log1p(rest["rps"]), day=rest["window_start"] // 86_400).groupby(["service", "day"])["l"].mean()
    base = np.log1p(both["rps"]) - mean.loc[list(zip(both["service"], both["window_start"] // 86_400))].to_numpy()
    err = np.log1p(both["rps"]) - np.log1p(both["value"])
    ratio = float(np.median(np.abs(err)) / np.median(np.abs(base)))
    print("held out", len(both), "median error", float(np.median(np.abs(err))), "of the mean's", ratio)
    assert len(both) > 4000 and ratio < 0.9


def _brute_spikes(pdf: pd.DataFrame) -> set:
    cases = set()
    for s, x in pdf.groupby("service"):
        x = x.sort_values("window_start").drop_duplicates("window_start")
        for f in ("rps", "error_rate", "p99"):
            y = x[x[f].notna()]
            v, t = y[f].to_numpy(), y["window_start"].to_numpy()
            if not len(v):
                continue
            bad = ~np.isfinite(v) | (v < 0) | ((v > 1) if f == "error_rate" else False) | ((v < y["p50"].to_numpy()) if f == "p99" else False)
            run = np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1
            good = v[~bad]
            stuck = (np.bincount(run)[run] >= 10) & (len(good) > 0 and good.min() < good.max())
            spike = np.zeros(len(v), bool)
            pos = ~bad & (v > 0)
            logs = np.log(v[pos])
            if len(logs) > 20:
                rest = logs - pd.Series(logs).rolling(21, center=True, min_periods=8).median().to_numpy()
                sd = 1.4826 * np.median(np.abs(rest))
                spike[np.flatnonzero(pos)[np.abs(rest) > 6 * sd]] = sd > 0
            cases |= {(s, int(a), f) for a in t[bad | stuck | spike]}
    return cases


def test_spikes_against_brute_force(spark):
    path = f"{DATA}/sf0.01"
    pdf = spark.read.parquet(f"{path}/aggregates.parquet").select("agg_id", "service", "window_start", "rps", "error_rate", "p50", "p99").toPandas().sort_values("agg_id")
    got = {(r["service"], r["window_start"], r["field"]) for r in P.p7_found(spark, path).collect()}
    want = _brute_spikes(pdf)
    assert want and got == want


def test_plausible_zeros_are_no_spikes(spark):
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(1, 0.2, 600))
    x[rng.choice(600, 48, replace=False)] = 0.0
    x[450] = 400.0
    df = spark.createDataFrame([(i, "s", i * 60, float(v)) for i, v in enumerate(x)], "id long, service string, t long, v double")
    got = spikes.flag_readings(df, "service", "t", {"v": F.col("v") < 0}, "id").collect()
    assert [(r["time"] // 60, r["spike"]) for r in got] == [(450, True)]
    x[100:112] = 0.0  # zeros still count for stuck runs
    df = spark.createDataFrame([(i, "s", i * 60, float(v)) for i, v in enumerate(x)], "id long, service string, t long, v double")
    got = spikes.flag_readings(df, "service", "t", {"v": F.col("v") < 0}, "id").where("stuck").collect()
    assert set(range(100, 112)) <= {r["time"] // 60 for r in got}


def test_spike_after_a_gap_is_seen(spark):
    """Seven scatters right after a gap of a day: the forecast is wide, the limit is not."""
    rng = np.random.default_rng(9)
    x, minute = np.exp(rng.normal(0, 0.1, 300)), np.r_[0:150, 1590:1740]
    x[150] = np.exp(0.8)
    df = spark.createDataFrame([(i, "s", int(m) * 60, float(v)) for i, (m, v) in enumerate(zip(minute, x))], "id long, service string, t long, v double")
    got = spikes.flag_readings(df, "service", "t", {"v": F.col("v") < 0}, "id").collect()
    assert [r["time"] // 60 for r in got] == [1590]


def test_stuck_is_vanishing_innovation_variance():
    value = np.array([1.0, 1, 1, 2, 2, 2, 2, np.inf, np.inf, np.inf, np.inf, 3, 3 + 1e-15, 3, 3, 5e-324, 0, 0, 0, 0])
    assert np.flatnonzero(spikes.stuck_readings(value, 4)).tolist() == [3, 4, 5, 6, 16, 17, 18, 19]
    assert not spikes.stuck_readings(value[:3], 4).any() and not spikes.stuck_readings(value[:0], 4).any()


def test_level_change_is_no_spike_and_chunks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(2, 0.1, 400))
    x[200:] *= 5
    x[100] *= 20
    x[300:304] /= 30
    x[50:62] = x[50]
    df = spark.createDataFrame([(i, "s", i * 60, float(v)) for i, v in enumerate(x)] + [(1000, "s", 0, float(x[0]))], "id long, service string, t long, v double")
    got = [{(r["time"] // 60, r["spike"], r["stuck"]) for r in spikes.flag_readings(df, "service", "t", {"v": F.col("v") < 0}, "id", chunk_s=c).collect()} for c in (86_400, 6_000)]
    want = {(100, True, False), *((i, True, False) for i in range(300, 304)), *((i, False, True) for i in range(50, 62))}
    assert got[0] == want and got[1] == want
