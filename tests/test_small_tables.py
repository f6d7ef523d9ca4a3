"""Small tables that go to the driver are taken whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from telemill.session import all_rows


def test_no_row_is_left_out_silently(spark, sf, tmp_path):
    assert len(all_rows(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        all_rows(spark.range(4), 3)
    sizes = spark.range(101).select(F.concat(F.lit("p"), "id").alias("pack_name"), (F.col("id") + 1000).alias("capacity_tokens"))
    sizes.write.parquet(str(tmp_path / "pack_sizes.parquet"))
    spark.read.parquet(f"{sf}/documents.parquet").limit(3).write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(ValueError):
        entry.queries()["p8_packs"](spark, str(tmp_path))
