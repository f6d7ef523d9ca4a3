"""Bounds of distinct counts hold for sets of every size."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.llm import distinct_counts


def test_bounds_hold(spark):
    sizes = [1, 2, 5, 12, 20, 48, 100, 300, 1000, 5000, 40_000]
    rows = spark.range(20).withColumnRenamed("id", "s").withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes[:9]]))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.unionByName(spark.range(40_000).selectExpr("0 AS s", "40000 AS n", "CAST(id AS int) AS i"))
    found = distinct_counts.estimate(distinct_counts.sketch(rows.withColumn("u", F.concat_ws("-", "s", "n", "i")), ["s", "n"], "u"), ["s", "n"])
    assert found.where("n NOT BETWEEN at_least AND at_most").count() == 0 and found.count() == 20 * 9 + 1
    assert found.where("n <= 20 AND (at_most - at_least > 1.2)").count() == 0


def test_the_plan_of_the_estimate_stays_small(spark):
    """The driver holds every copy of an expression: bounds of bounds in one Column made a plan of a million characters."""
    rows = spark.range(3).selectExpr("id AS s", "CAST(id AS string) AS u")
    plans = distinct_counts.estimate(distinct_counts.sketch(rows, ["s"], "u"), ["s"])._jdf.queryExecution()
    assert len(plans.analyzed().toString()) < 50_000 and len(plans.optimizedPlan().toString()) < 50_000
