"""Frequent items: size of the sketches over many groups, and which delivery of a record counts."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from telemill.llm import heavy_hitters, queries

from ..oracle import assert_same


def test_many_groups_compress(spark):
    """130 groups of 2,000 rows with 40 values: the sketch of a group in a part is never larger than its values."""
    rows = spark.range(260_000).select((F.col("id") % 130).cast("int").alias("grp"), F.concat(F.lit("v"), F.col("id") % 5200 % 40).alias("item"), "id")
    parts = heavy_hitters.sketch(heavy_hitters.place(rows, "grp", F.xxhash64("id")), "grp", "item", placed=True).cache()
    n_parts = parts.where("kind = 0").count()
    assert parts.count() <= n_parts * 41 and n_parts <= 130 + 8  # a range holds whole groups but for its ends
    loose = heavy_hitters.sketch(rows, "grp", "item")  # not placed: sorted in its partitions
    assert loose.count() <= 2 * 130 * 41 * rows.rdd.getNumPartitions()
    for sketches in (parts, loose):
        got = heavy_hitters.frequent_items(sketches)
        assert got.where("at_least > at_most").count() == 0
        assert got.agg(F.sum("at_least")).first()[0] == 260_000


def test_one_hot_group_is_many_parts(spark):
    rows = spark.range(400_000).select(F.lit("hot").alias("grp"), F.when(F.col("id") % 3 == 0, "top").otherwise(F.concat(F.lit("x"), "id")).alias("item"), "id")
    parts = heavy_hitters.sketch(heavy_hitters.place(rows.repartition(8), "grp", F.xxhash64("id")), "grp", "item", placed=True)
    top = heavy_hitters.frequent_items(parts).where("at_most * 100 >= total").collect()
    assert [r["item"] for r in top] == ["top"] and top[0]["at_least"] <= 133_334 <= top[0]["at_most"] and top[0]["total"] == 400_000


def test_first_delivery_decides_the_day(spark, tmp_path):
    """A record first delivered without event time keeps its day, whatever a later copy says."""
    schema = "log_id long, ts_unix long, event_ts timestamp_ntz, service string, env string, level string, user_id string, account_id string, endpoint string, operation string, latency_ms double"
    day = 1_709_510_400
    given = spark.createDataFrame([(i, day + i, None, "s", None, None, "u1", None, "/a/?x=1", None, None) for i in range(5)], schema)
    again = given.withColumns({"ts_unix": F.col("ts_unix") + 50, "event_ts": F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")})
    nameless = spark.createDataFrame([(None, day, None, "s", None, None, "u1", None, "/b", None, None)] * 3, schema)
    given.unionByName(again).unionByName(nameless).write.parquet(str(tmp_path / "log_events.parquet"))
    found = queries.p2_found(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(20240304, "endpoint", "/a"), (20240304, "endpoint", "/b"), (20240304, "user_id", "u1")]
    given.unionByName(again).write.mode("overwrite").parquet(str(tmp_path / "log_events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW log_events AS SELECT * FROM '{tmp_path}/log_events.parquet/*.parquet'")
    assert_same(queries.p2_found(spark, str(tmp_path)), con, queries.ORACLE_SQL["p2_found"])
