"""Isolation-forest scores with a supplied model.

Small acyclic trees become nested CASE expressions and stay inside code
generation; other models run in an Arrow UDF that walks all rows of a batch step
by step. Defined results: no or an unreadable model scores 0; features that are
null, NaN or unknown count as 0; a walk ends after 64 steps or at a bad child.
"""

from __future__ import annotations

import json
import math
import os
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 64
FEATURES = ("p99", "error_rate", "rps")
_KNOWN = ("p50", "p95", "p99", "rps", "error_rate", "count")
#: Euler's constant in the mean path length.
_GAMMA = 0.5772156649015329


def mean_path(n: int) -> float:
    """c(n): mean path length of an unsuccessful search among n points; n <= 1 counts as 256."""
    n = n if n > 1 else 256
    return 2.0 * (math.log(n - 1) + _GAMMA) - 2.0 * (n - 1) / n


def load_model(options: dict[str, Any]) -> list[list[dict]]:
    """Trees from model_path, model (text, path, {path} or struct) or model_inline, in this order; [] if none can be read."""

    def read(x: Any) -> Any:
        if isinstance(x, dict):
            return read(x["path"]) if set(x) == {"path"} else x
        if isinstance(x, str) and x.lstrip().startswith("{"):
            return json.loads(x)
        if isinstance(x, str) and os.path.exists(x):
            with open(x) as f:
                return json.load(f)
        return None

    for key in ("model_path", "model", "model_inline"):
        try:
            got = read(options.get(key)) if options.get(key) else None
            if got:
                return [t.get("nodes") or [] for t in got.get("trees") or []]
        except (ValueError, OSError, AttributeError, KeyError):
            continue
    return []


def _node(n: dict) -> tuple[int, float, int, int, bool]:
    f, t, left, right = int(n.get("f") or 0), float(n.get("t") or 0), int(n.get("l") or 0), int(n.get("r") or 0)
    return f, t, left, right, bool(n.get("leaf")) or (f == 0 and t == 0 and left == 0 and right == 0)


def _walks_forward(trees: list[list[dict]], limit: int) -> bool:
    """Whether every child comes after its parent (no cycles) and the model is small."""
    if sum(len(t) for t in trees) > limit:
        return False
    return all(leaf or (left > i and right > i) for t in trees for i, (_, _, left, right, leaf) in enumerate(map(_node, t)))


def _tree_depth(nodes: list[dict], x: list[Column]) -> Column:
    def at(i: int, depth: int) -> Column:
        if i >= len(nodes) or depth >= MAX_STEPS:
            return F.lit(depth)
        f, t, left, right, leaf = _node(nodes[i])
        if leaf:
            return F.lit(depth)
        value = x[f] if 0 <= f < len(x) else F.lit(0.0)
        return F.when(value <= t, at(left, depth + 1)).otherwise(at(right, depth + 1))

    return at(0, 0)


def _batch_depth(nodes: list[dict], x: np.ndarray) -> np.ndarray:
    n = len(x)
    depth, at, live = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
    if not nodes:
        return depth
    f, t, left, right, leaf = (np.array(c) for c in zip(*map(_node, nodes)))
    for _ in range(MAX_STEPS):
        live &= ~leaf[at] if live.any() else False
        i = np.flatnonzero(live)
        if not len(i):
            break
        node = at[i]
        feature = f[node]
        good = (feature >= 0) & (feature < x.shape[1])
        value = np.where(good, x[i, np.where(good, feature, 0)], 0.0)
        child = np.where(value <= t[node], left[node], right[node])
        depth[i] += 1
        bad = (child < 0) | (child >= len(nodes))
        live[i[bad]] = False
        at[i[~bad]] = child[~bad]
    return depth


def feature_vector(names: tuple[str, ...] = FEATURES) -> list[Column]:
    clean = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return [clean(F.col(n).cast("double")) if n in _KNOWN else F.lit(0.0) for n in names]


def score(x: list[Column], trees: list[list[dict]], subsample: int = 256, compile_limit: int = 512) -> Column:
    """exp(-mean depth / c(n)), within [0, 1]; 0 without trees."""
    if not trees:
        return F.lit(0.0)
    c = mean_path(subsample)
    if _walks_forward(trees, compile_limit):
        depth = sum((_tree_depth(t, x) for t in trees), F.lit(0)) / len(trees)
    else:
        width = len(x)

        @F.pandas_udf("double")
        def walk(batch: pd.Series) -> pd.Series:
            rows = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, width))
            return pd.Series(sum(_batch_depth(t, rows) for t in trees) / len(trees))

        depth = walk(F.array(*x))
    return F.least(F.greatest(F.exp(-depth / c), F.lit(0.0)), F.lit(1.0))


def with_score(aggregates: DataFrame, trees: list[list[dict]], features: tuple[str, ...] = FEATURES, normalise: str = "none", subsample: int = 256, threshold: float | None = None, slot=None) -> DataFrame:
    """aggregates with anomaly_score, and is_anomaly if a threshold is given; normalise "zscore" standardises per service."""
    if normalise == "zscore":
        from telemill.operators.series import running_zscore

        used = [f for f in features if f in _KNOWN]
        clean = aggregates.withColumns({f"x_{f}": F.when(F.isnan(F.col(f).cast("double")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in used})
        z = running_zscore(clean, "service", ["window_start"], [f"x_{f}" for f in used], slot=slot)
        x = [F.col(f"z_x_{f}") if f in used else F.lit(0.0) for f in features]
        out = z.withColumn("anomaly_score", score(x, trees, subsample)).select(*[c for c in aggregates.columns if c != "anomaly_score"], "anomaly_score")
    else:
        out = aggregates.withColumn("anomaly_score", score(feature_vector(features), trees, subsample))
    return out if threshold is None else out.withColumn("is_anomaly", F.col("anomaly_score") >= threshold)
