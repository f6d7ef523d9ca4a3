"""Queries that leave nothing of their table out."""

from __future__ import annotations

import __spark_entry__ as entry

from telemill.operators import vectors
from telemill.plans import reference_queries

from .oracle import assert_same, connect


def test_every_component_of_a_vector(spark, sf):
    got = entry.queries()["v7_l2"](spark, sf).groupBy("vec_id").count()
    want = connect(sf).execute("SELECT vec_id, len(embedding) FROM embeddings").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {n for _, n in want} == {64}


def test_every_aggregate_has_its_trace_text(spark, sf, tmp_path):
    """Also with ten labels, none, a null map, null and empty values, and measures that are null, NaN or infinite."""
    base = spark.read.parquet(f"{sf}/aggregates.parquet")
    many = {f"k{i}": str(i) for i in (9, 3, 7, 1, 8, 2, 6, 4, 5, 0)} | {"operation": "o", "env": "", "source": "s"}
    rows = [(1, "a", many, 1.0, None), (2, "a", {}, float("nan"), ""), (3, None, None, float("inf"), "s"), (4, "a", {"b": None, "a": "x"}, float("-inf"), "s"), (5, "a", {"z": "1"}, None, "s")]
    odd = spark.createDataFrame([(i, s, m, v, t) for i, s, m, v, t in rows], "agg_id long, service string, labels map<string,string>, rps double, summary string")
    base.unionByName(odd, allowMissingColumns=True).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "d").mkdir()
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "d" / "aggregates.parquet")
    got = entry.queries()["v3_trace_text"](spark, str(tmp_path / "d"))
    assert got.count() == base.count() + 5
    assert_same(got, connect(str(tmp_path / "d")), reference_queries.ORACLE_SQL["v3_trace_text"])
    text = {r["agg_id"]: r["text"] for r in got.where("agg_id <= 5 AND text LIKE '%p50=0.000000%'").collect()}
    assert " error_rate=0.000000 source=s operation=o" in text[1] and "k0" not in text[1] and "env" not in text[1]


def test_every_aggregate_has_its_vector_and_texts(spark, sf):
    n = spark.read.parquet(f"{sf}/aggregates.parquet").count()
    for name in ("v1_vectorize", "v2_log_text", "v5_fallback_summary", "v6_pca"):
        assert entry.queries()[name](spark, sf).select("agg_id").count() == n
    assert entry.queries()["v4_metric_vector"](spark, sf).count() == 8 * n
