"""Exact percentiles of groups of any size, from counted values.

No task holds the values of a group: values are counted by (group, value), which
spreads a hot group, and summed by (group, bucket of the value); running sums over
a group's buckets, a few thousand at most, tell which of them hold the wanted
ranks, and only the values of those buckets are put in order.

Defined results: linear interpolation at q (n - 1); NaN is above every number;
groups without values are not in the result; null keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to a factor of e: a bucket spans 0.3 percent of its values.
_FINE = 370


def _bucket(v: Column) -> Column:
    """A whole number that never falls as v grows."""
    size = lambda x: F.floor(F.ln(x) * _FINE) + 1_000_000
    inner = F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0)
    return F.when(F.isnan(v), 3_000_000).when(v == float("inf"), 2_000_000).when(v == float("-inf"), -2_000_000).otherwise(inner).cast("int")


def group_percentiles(counted: DataFrame, keys: Sequence[str], value: str, n: str, points: dict[str, float]) -> DataFrame:
    """keys and one column a point (name -> q) over rows of value (double) that stand for n values each."""
    keys = list(keys)
    given = counted.where(F.col(value).isNotNull() & (F.col(n) > 0)).select(*keys, F.col(value).cast("double").alias("__v"), F.col(n).alias("__n")).withColumn("__b", _bucket(F.col("__v")))
    order = Window.partitionBy(*keys).orderBy("__b")
    coarse = given.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n")).withColumns(
        {"__before": F.sum("__n").over(order) - F.col("__n"), "__total": F.sum("__n").over(Window.partitionBy(*keys))}
    )
    at = [F.lit(q) * (F.col("__total") - 1) for q in points.values()]
    ranks = [r for x in at for r in (F.floor(x), F.ceil(x))]
    held = F.lit(False)
    for r in ranks:
        held = held | ((F.col("__before") <= r) & (r < F.col("__before") + F.col("__n")))
    wanted = coarse.where(held).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__wb"), "__before", "__total")
    same = F.col("__b") == F.col("__wb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = given.join(wanted, same).withColumn("__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__b").orderBy("__v")))
    first = inside.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") > r, F.col("__v"))).alias(f"__r{i}") for i, r in enumerate(ranks)], F.max("__total").alias("__total"))
    between = {}
    for i, (name, q) in enumerate(points.items()):
        lo, hi = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
        x = F.lit(q) * (F.col("__total") - 1)
        between[name] = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x)))
    return first.select(*keys, *[c.alias(name) for name, c in between.items()])
