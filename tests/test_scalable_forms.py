"""Forms that spread a hot group against the plain ones: percentiles, deltas in chunks, chains of renames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.functions.percentiles import _bucket, group_percentiles
from telemill.operators import logs, metrics, schema_drift

POINTS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.lognormal(3, 2, 700), "b": -rng.lognormal(0, 1, 301), "c": np.array([7.0]), "d": np.repeat([0.0, 1.0, 1.0000001], [50, 3, 60]), None: rng.normal(0, 1e-9, 200), "e": np.array([float("inf"), -5.0, 5.0, float("-inf")]),
        "f": np.array([5e-324, 1e308, 0.0, -1e308]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    counted = spark.createDataFrame(rows, "k string, v double").repartition(5).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r for r in group_percentiles(counted, ["k"], "v", "n", POINTS).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, q in POINTS.items():
            x = sorted(vs)
            at = q * (len(x) - 1)
            lo, hi = x[math.floor(at)], x[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)


def test_percentiles_of_nothing_and_nan(spark):
    none = spark.createDataFrame([], "k string, v double, n long")
    assert group_percentiles(none, ["k"], "v", "n", POINTS).count() == 0
    odd = spark.createDataFrame([("a", None, 3), ("a", 1.0, 0), ("b", 2.0, 2), ("b", float("nan"), 1)], "k string, v double, n long")
    got = group_percentiles(odd, ["k"], "v", "n", {"p50": 0.5, "p100": 1.0}).collect()
    assert [(r["k"], r["p50"]) for r in got] == [("b", 2.0)] and math.isnan(got[0]["p100"])


def test_buckets_never_fall(spark):
    x = np.sort(np.r_[-np.logspace(-300, 300, 400), 0.0, np.logspace(-300, 300, 400), [float("inf"), float("-inf")]])
    got = [r["b"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", _bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 700


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_deltas_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(s, int(t), i, float(v)) for i, (s, t, v) in enumerate(zip(rng.choice(["a", "b", "c"], 200), rng.integers(-50, 50, 200), rng.integers(0, 30, 200)))]
    rows += [("lone", 3, 900, 5.0), (None, 1, 901, 2.0), (None, 90, 902, 6.0), ("null", 1, 903, None), ("null", 60, 904, 4.0)]
    df = spark.createDataFrame(rows, "s string, t long, i int, v double")
    got = {r["i"]: r["delta"] for r in metrics.counter_delta(df, "s", ["t", "i"], "v", chunk=chunk).collect()}
    last, want = {}, {}
    for s, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = None if v is None else max(v - (last.get(s) or 0.0), 0.0)
        last[s] = v
    assert {i: d for i, d in got.items() if i != 903} == {i: d for i, d in want.items() if i != 903} and len(got) == len(rows)


def test_long_chains_of_renames(spark):
    """a -> k1 -> k2 ... over 20 files, a key used again, and two feeds that don't mix."""
    chain = ["a", *[f"k{i}" for i in range(1, 20)]]
    rows = [("f", i + 2, "renamed", chain[i], chain[i + 1]) for i in range(19)]
    rows += [("g", 3, "renamed", "a", "k1"), ("g", 5, "renamed", "b", "a"), ("g", 7, "renamed", "a", "c"), ("f", 4, "added", "x", "x")]
    change = spark.createDataFrame(rows, "feed string, file_no long, change_kind string, field string, new_name string")
    lines = spark.createDataFrame([("f", i, "{}") for i in range(1, 23)] + [("g", i, "{}") for i in range(1, 9)] + [(None, 1, "{}"), ("g", None, "{}")], "feed string, file_no long, raw string")
    names = {(r["feed"], r["file_no"]): r["names"] for r in schema_drift.field_names(lines, change, ["a", "b", "z"]).collect()}
    assert len(names) == 30 and all(n["z"] == "z" for n in names.values())
    assert [names["f", i]["a"] for i in range(1, 23)] == [*chain, "k19", "k19"]
    assert [names["g", i]["a"] for i in range(1, 9)] == ["a", "a", "k1", "k1", "k1", "k1", "k1", "k1"]
    assert [names["g", i]["b"] for i in range(1, 9)] == ["b", "b", "b", "b", "a", "a", "c", "c"]


def test_renames_that_swap(spark):
    change = spark.createDataFrame([("f", 2, "renamed", "a", "b"), ("f", 2, "renamed", "b", "a")], "feed string, file_no long, change_kind string, field string, new_name string")
    got = {(r["root"], r["new_name"]) for r in schema_drift.rename_roots(change).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_a_sample_is_seeded_and_bounded(spark):
    rows = spark.range(3000).selectExpr("'s' AS service", "id % 120 AS ts", "id * 1.0 AS latency_ms", "id")
    take = lambda seed, df: sorted((r["window_start"], r["value"]) for r in logs.reservoir(df, 60, cap=10, seed=seed).collect())
    assert take(1, rows) == take(1, rows.repartition(7)) != take(2, rows)
    assert len(take(1, rows)) == 20
