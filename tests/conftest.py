from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 3g pyspark-shell")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from telemill.session import build_session

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    from tests.oracle import DATA

    return os.environ.get("TEST_SF_DIR", f"{DATA}/sf0.001")


@pytest.fixture(scope="session")
def variant_dirs(spark, sf, tmp_path_factory):
    """Copies of the small tables: "empty" without rows, "wide" with extra columns that clash with internal names."""
    from pyspark.sql import functions as F

    out = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "wide", "nulls")}
    clash = ("source", "value", "time", "chunk", "task", "rank", "id", "key", "item", "grp", "hash", "slot", "tokens", "day", "combo", "level_", "bits", "word", "user", "r", "v", "body", "event", "arrival", "tie", "block", "near", "curve", "unit", "n")
    for name in ("log_events", "envelopes", "aggregates", "daily_aggregates", "aggregate_vectors", "raw_logs", "documents", "source_targets", "pack_sizes", "log_fields"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.limit(0).write.parquet(f"{out['empty']}/{name}.parquet")
        extra = [c for c in clash if c not in df.columns]
        df.withColumns({c: F.lit("x") for c in extra}).write.parquet(f"{out['wide']}/{name}.parquet")
        # Every column null in one more row each, a row of nulls only, and every row twice over that.
        keep = df if name in ("log_fields", "pack_sizes", "source_targets") else None
        if keep is None:
            some = df.limit(3)
            broken = [some.withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in df.columns]
            broken.append(df.limit(1).select([F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
            keep = df
            for b in broken:
                keep = keep.unionAll(b)
        keep.write.parquet(f"{out['nulls']}/{name}.parquet")
    return out
