"""Averages whose old rows still weigh, in one long chunk."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telemill.operators import series


@pytest.mark.parametrize("alpha", [0.001, 0.3, 1.0])
def test_average_over_a_long_chunk(spark, alpha):
    values = [1000.0 if i < 700 else float(i % 7) for i in range(6000)]
    rows = spark.createDataFrame(list(enumerate(values)), "t long, v double").withColumn("service", F.lit("s"))
    got = [r["ema_v"] for r in series.exponential_average(rows, "service", ["t"], ["v"], alpha).orderBy("t").collect()]
    want, s = [], 0.0
    for v in values:
        s = alpha * v + (1 - alpha) * s
        want.append(s)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
