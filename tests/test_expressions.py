"""The filter language against a small independent interpreter, and its fail-open rules."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.filters.expressions import ParseError, _Parser, apply_filter, filter_aggregates, filter_envelopes, predicate

ROWS = [(1, "a", 0.9, 10, {"env": "prod"}), (2, "b", 0.1, None, {}), (3, None, float("nan"), 0, {"env": "dev", "x": "1"}), (4, "ab", -1.0, 5, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, service string, score double, count long, attrs map<string,string>").cache()


def kept(df, expression):
    return {r["id"] for r in df.where(predicate(expression, df)).collect()}


@pytest.mark.parametrize(
    "expression,want",
    [
        ('attrs["env"] == "prod"', {1, 2, 4}),  # a missing key is an error, errors keep the row
        ('attrs.env == "prod" || score > 0.5', {1, 2, 4}),
        ('!(attrs.env == "prod")', {2, 3, 4}),
        ("score > 0.5", {1}),
        ("score != score", {3}),
        ("score >= 0.1 && count > 5", {1, 2}),
        ("score > 1.0 && count > 5", set()),  # false absorbs the error
        ("count / 0 == 1", {1, 2, 3, 4}),
        ("count % 5 == 0", {1, 2, 3, 4}),
        ('count > 3 ? service == "a" : false', {1, 2}),
        ('service in ["a", "b"]', {1, 2, 3}),
        ('"env" in attrs', {1, 3, 4}),
        ("has(attrs.env) && size(attrs) == 2", {3, 4}),
        ('service.startsWith("a") && service.size() >= 0', {1, 3, 4}),
        ('service.matches("^a.$")', {3, 4}),
        ('service + "x" == "ax"', {1, 3}),
        ("service == 5", {3}),  # values of different types aren't equal; the null is a failure
        ("service != 5", {1, 2, 3, 4}),
        ("service < 5", {1, 2, 3, 4}),  # but they have no order
        ("count * 1.5 > 0.0", {1, 2, 3, 4}),  # ints and doubles don't mix in arithmetic
        ("count / 4 == 2", {1, 2}),  # ints divide towards zero
        ("-7 / 2 == -3 && 7 % 4 == 3", {1, 2, 3, 4}),
        ("score / 0.0 > 1.0", {1, 2}),  # doubles divide by zero
        ("count in [1, 2]", {2}),
        ('id in ["a", 2]', {2}),
        ("service in [1, 2]", {3}),
        ('attrs.env.size() > 3', {1, 2, 4}),
        ('no_such_name > 1 && attrs.env == "prod"', {1, 2, 4}),
        ('no_such_name > 1 || attrs.env == "prod"', {1, 2, 3, 4}),
        ("service.http.status == 500", {1, 2, 3, 4}),
        ('service.matches("[") || false', {1, 2, 3, 4}),
        ("no_such(service) && id > 2", {3, 4}),
        ('attrs.exists(k, k == "x")', {3, 4}),
        ("attrs.all(k, attrs[k].size() > 1)", {1, 2, 4}),
        ("[1, 2, 3].exists_one(i, i == id)", {1, 2, 3}),
        ("[1, 2, 3, 4].filter(i, i > id).size() == 2", {2}),
        ("[1, 2].map(i, i * 2).exists(j, j == id)", {2, 4}),
        ("[1, 2, 3].map(i, i > 1, i + 1) == [3, 4]", {1, 2, 3, 4}),
        ("id > 2 ? score : service == 5", {3, 4}),
        ("0x10 == 16 && r\"\\d\" == \"\\\\d\" && null == null && 1 == 1.0", {1, 2, 3, 4}),
        ("9223372036854775807 + id > 0", {1, 2, 3, 4}),
        ("service", {1, 2, 3, 4}),  # not boolean
        ("1 + 1", {1, 2, 3, 4}),
        ("no_such_name > 1", {1, 2, 3, 4}),
        ("((", {1, 2, 3, 4}),
        ("int(attrs.x) == 1", {1, 2, 3, 4}),
        ("false", set()),
        ("!true || -score > 0.5", {4}),
    ],
)
def test_expressions(df, expression, want):
    assert kept(df, expression) == want


def test_no_op_filters(df):
    assert apply_filter(df, "false", drop_non_matching=False).count() == 4
    assert apply_filter(df, "  ").count() == 4


def test_environments(spark):
    e = spark.createDataFrame([("json_logs", bytearray(b'{"level":"info"}'), {"env": "prod"}, 5), ("metrics", bytearray(b"\x00\xff"), {}, 9)], "kind string, bytes binary, attrs map<string,string>, ts_unix long")
    assert [r["ts_unix"] for r in filter_envelopes(e, 'log.level == "error"', on="logs").collect()] == [9]
    assert filter_envelopes(e, 'metric_name == "x"').count() == 0
    assert filter_envelopes(e, "now_unix > ts_unix && kind == \"metrics\"").count() == 1
    assert filter_aggregates(e, "ts_unix < 6").count() == 1


LOGS = {
    1: '{"latency_ms":5,"ok":true,"http":{"status":500,"tags":["a","b"]},"n":null,"name":"x"}', 2: '{"latency_ms":500,"ok":false,"http":{"status":200,"tags":[]}}',
    3: '{"latency_ms":"500","ok":"true","http":"none"}', 4: "not json", 5: "[1]", 6: "{}",
}


@pytest.mark.parametrize(
    "expression,want",
    [
        ("log.latency_ms > 100", {2, 3, 4, 5, 6}),
        ("log.latency_ms == 5", {1, 4, 5, 6}),
        ("log.latency_ms * 2.0 > 100.0", {2, 3, 4, 5, 6}),
        ("log.ok == true", {1, 4, 5, 6}),
        ("log.ok", {1, 3, 4, 5, 6}),  # a text isn't boolean
        ("log.http.status == 500", {1, 3, 4, 5, 6}),
        ('log["http"]["tags"][0] == "a"', {1, 2, 3, 4, 5, 6}),
        ('log.http.tags.exists(t, t == "b")', {1, 3, 4, 5, 6}),
        ('"a" in log.http.tags', {1, 3, 4, 5, 6}),
        ("log.http.tags.size() == 2 && size(log) == 5", {1}),
        ("has(log.n) && log.n == null", {1}),
        ("has(log.http.status)", {1, 2, 3, 4, 5, 6}),
        ('log.name + "y" == "xy"', {1, 2, 3, 4, 5, 6}),
        ('log.exists(k, k.startsWith("lat"))', {1, 2, 3}),
        ("log.http == log.http", {1, 2, 3, 4, 5, 6}),
        ("log.latency_ms != log.ok", {1, 2, 3, 4, 5, 6}),
        ("log.latency_ms == log.ok", {4, 5, 6}),
        ("string(log.latency_ms) == \"5\" || int(log.latency_ms) == 500", {1, 2, 3, 4, 5, 6}),
        ("kind == \"json_logs\"", {1, 2, 3, 4, 5, 6}),  # not a name of logs
        ("ts_unix > 3", {4, 5, 6}),
    ],
)
def test_logs(spark, expression, want):
    e = spark.createDataFrame([("json_logs", bytearray(t.encode()), None, i) for i, t in LOGS.items()], "kind string, bytes binary, attrs map<string,string>, ts_unix long")
    assert {r["ts_unix"] for r in filter_envelopes(e, expression, on="logs").collect()} == want


def test_other_environments(spark):
    e = spark.createDataFrame([("traces", bytearray(b"x"), {"env": "prod"}, 5), ("metrics", None, None, 9)], "kind string, bytes binary, attrs map<string,string>, ts_unix long")
    kept = lambda text, on: {r["ts_unix"] for r in filter_envelopes(e, text, on=on).collect()}
    assert kept('span_name == "" && duration_ms == 0.0 && size(attributes) == 0 && kind == "traces"', "traces") == {5}
    assert kept('item.kind == "traces" && item.attrs.env == "prod" && item.ts_unix < 6', "spans") == {5}
    assert kept("size(resource) + size(labels) == 0 && ts_unix > 6", "metrics") == {9}


NAMES = {"a": [True, False, None], "b": [True, False, None]}
trees = st.recursive(
    st.sampled_from([("name", "a"), ("name", "b"), ("lit", True), ("lit", False)]),
    lambda t: st.one_of(st.tuples(st.just("op"), st.sampled_from(["&&", "||"]), st.lists(t, min_size=2, max_size=2)), st.tuples(st.just("op"), st.just("u!"), st.lists(t, min_size=1, max_size=1)), st.tuples(st.just("if"), t, t, t)),
    max_leaves=8,
)


def text_of(t):
    if t[0] == "name":
        return t[1]
    if t[0] == "lit":
        return str(t[1]).lower()
    if t[0] == "if":
        return f"({text_of(t[1])} ? {text_of(t[2])} : {text_of(t[3])})"
    return f"!({text_of(t[2][0])})" if t[1] == "u!" else f"({text_of(t[2][0])} {t[1]} {text_of(t[2][1])})"


def value_of(t, env):
    """None is an error; && and || absorb it."""
    if t[0] == "name":
        return env[t[1]]
    if t[0] == "lit":
        return t[1]
    if t[0] == "if":
        c = value_of(t[1], env)
        return None if c is None else value_of(t[2] if c else t[3], env)
    x = [value_of(y, env) for y in t[2]]
    if t[1] == "u!":
        return None if x[0] is None else not x[0]
    decisive = t[1] == "||"
    return decisive if decisive in x else None if None in x else not decisive


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=4, max_size=4))
def test_logic_matches_interpreter(spark, made):
    envs = [(a, b) for a in NAMES["a"] for b in NAMES["b"]]
    rows = spark.createDataFrame(envs, "a boolean, b boolean")
    got = rows.select("a", "b", *[predicate(text_of(t), rows).alias(f"p{i}") for i, t in enumerate(made)]).collect()
    for r in got:
        for i, t in enumerate(made):
            want = value_of(t, {"a": r["a"], "b": r["b"]})
            assert r[f"p{i}"] == (True if want is None else want), text_of(t)


def test_parse_errors():
    for bad in ("a ==", "a b", "[1, 2", "f(", "a ? b", "#"):
        with pytest.raises(ParseError):
            _Parser(bad).parse()


def test_filters_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/aggregates.parquet")
    plan = filter_aggregates(rows, "count > 100").select("agg_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<agg_id:bigint,count:bigint>" in plan
    assert F is not None
