"""Per-key state on streams: counter deltas, running z-scores, exponential averages.

One small state row a key; inside a micro-batch the rows of a key are taken in
order of time. With idle_ms idle keys time out; leave it out for triggers that end,
since timeouts keep a query awake.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, np.ndarray], tuple[tuple, np.ndarray]]


def _run(rows: DataFrame, key: str, order: list[str], value: str, out: str, state: str, first: tuple, step: Step, idle_ms: int | None) -> DataFrame:
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` double"

    def update(_: Any, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        now = held.get if held.exists else first
        now, result = step(tuple(now), pdf[value].to_numpy(dtype=np.float64))
        held.update(now)
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        made = pdf[names].copy()
        made[out] = result
        for c in made.columns:
            if made[c].dtype.kind not in "biufM":
                made[c] = made[c].astype(object)
        yield made

    return rows.groupBy(key).applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def counter_delta(rows: DataFrame, series: str, order: list[str], value: str, out: str = "delta", idle_ms: int | None = None) -> DataFrame:
    """max(current - previous, 0); the first point counts in full."""

    def step(s: tuple, x: np.ndarray) -> tuple[tuple, np.ndarray]:
        before = np.r_[s[0], x[:-1]] if len(x) else x
        return (float(x[-1]),) if len(x) else s, np.maximum(x - before, 0.0)

    return _run(rows, series, order, value, out, "last double", (0.0,), step, idle_ms)


def running_zscore(rows: DataFrame, key: str, order: list[str], value: str, out: str = "z", idle_ms: int | None = None) -> DataFrame:
    """(x - mean) / sample deviation over all rows of the key so far, this one included."""

    def step(s: tuple, x: np.ndarray) -> tuple[tuple, np.ndarray]:
        n, mean, m2 = s
        z = np.zeros(len(x))
        for i, v in enumerate(x.tolist()):
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
            sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            z[i] = (v - mean) / sd if sd > 1e-9 else 0.0
        return (n, mean, m2), z

    return _run(rows, key, order, value, out, "n long, mean double, m2 double", (0, 0.0, 0.0), step, idle_ms)


def exponential_average(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, out: str = "ema", idle_ms: int | None = None) -> DataFrame:
    """s = alpha x + (1 - alpha) s, from s = 0."""

    def step(s: tuple, x: np.ndarray) -> tuple[tuple, np.ndarray]:
        now, result = s[0], np.zeros(len(x))
        for i, v in enumerate(x.tolist()):
            now = alpha * v + (1 - alpha) * now
            result[i] = now
        return (float(now),), result

    return _run(rows, key, order, value, out, "s double", (0.0,), step, idle_ms)
