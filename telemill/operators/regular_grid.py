"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

Readings are first reduced to one per (source, slot) with map-side partial
aggregation, so a source with a third of all rows is at most one row per slot
afterwards. Then each day is one source-by-time matrix of all its sources.
Alternating least squares with a ridge fits rank-k factors to the observed
cells; missing cells take the fitted value, observed cells keep theirs exactly,
and cells without support (too few readings in their row or column) stay null
and marked.

Scale: a day of at most block_sources sources is fitted in one task. The
sources of a wider day lie in many tasks, one packed row each; a sweep solves
the factors of the sources where they lie, adds up the normal equations of the
slots over all of them and solves these, so that every source of the day has its
part in every slot's factors. A task holds block_sources sources at a time, and
the driver the factors of DAYS_AT_ONCE days (a few numbers a slot).

Defined results: null and NaN values are no reading, but their row still
counts for the extent of the source's day; infinite or negative values stay
as read but are not used for fitting; of several readings in one slot the one
with the smallest tie-break id stays; rows without source or time are left
out; a source alone on its day stays unsupported; an empty input gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.frames import frame
from telemill.session import stored

OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"
#: Wide days whose factors are found together.
DAYS_AT_ONCE = 256
_GRID = "source string, slot_start long, value double, status string"


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled logarithms of the usable readings (0 elsewhere), where they are, mean and scatter of every row."""
    with np.errstate(invalid="ignore"):
        usable = np.isfinite(x) & (x >= 0)
    z = np.where(usable, np.log1p(np.where(usable, x, 0.0)), 0.0)
    m = usable.astype(np.float64)
    n_row = m.sum(1)
    mean = z.sum(1) / np.maximum(n_row, 1)
    sd = np.sqrt((m * (z - mean[:, None]) ** 2).sum(1) / np.maximum(n_row, 1))
    sd[sd < 1e-9] = 1.0
    return m * (z - mean[:, None]) / sd[:, None], m, mean, sd


def _start(z_sum: np.ndarray, n_col: np.ndarray, n_sources: int, rank: int) -> np.ndarray:
    """Slot factors to begin with."""
    v = np.random.default_rng(0).normal(scale=0.3, size=(len(n_col), max(1, min(rank, n_sources - 1))))
    v[:, 0] = z_sum / np.maximum(n_col, 1) + 0.05
    return v


def _equations(z: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the rows of z, whose columns have the factors v; they add up over the columns."""
    return m @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1), z @ v


def _solved(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    k = b.shape[1]
    return np.linalg.solve(a.reshape(-1, k, k) + ridge * np.eye(k), b[:, :, None])[:, :, 0]


def _fitted(u: np.ndarray, v: np.ndarray, m: np.ndarray, mean: np.ndarray, sd: np.ndarray, n_col: np.ndarray, min_row: int, min_col: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        fit = np.maximum(np.expm1(u @ v.T * sd[:, None] + mean[:, None]), 0.0)
    fit[(m.sum(1) < min_row)[:, None] | (n_col < min_col)[None, :]] = np.nan
    return fit


def als_fill(x: np.ndarray, rank: int, ridge: float, sweeps: int, min_row: int, min_col: int) -> np.ndarray:
    """Fitted values of a source-by-time matrix of positive-scale readings; NaN where unsupported."""
    z, m, mean, sd = _scaled(x)
    n_col = m.sum(0)
    v = _start(z.sum(0), n_col, len(x), rank)
    u = np.zeros((len(x), v.shape[1]))
    for _ in range(sweeps):
        u = _solved(*_equations(z, m, v), ridge)
        v = _solved(*_equations(z.T, m.T, u), ridge)
    return _fitted(u, v, m, mean, sd, n_col, min_row, min_col)


def _cells(names: np.ndarray, day_start: int, step_s: int, x: np.ndarray, first: np.ndarray, last: np.ndarray, fit: np.ndarray) -> pd.DataFrame:
    """A row for every slot from the first to the last of each source."""
    seen, at = ~np.isnan(x), np.arange(x.shape[1])
    r, c = np.nonzero((at >= first[:, None]) & (at <= last[:, None]))
    out = np.where(seen[r, c], x[r, c], fit[r, c])
    status = np.where(seen[r, c], OBSERVED, np.where(np.isnan(out), UNSUPPORTED, FILLED))
    return frame({"source": names[r].astype(object), "slot_start": day_start + c * step_s, "value": out, "status": status})


def _matrices(batches: Iterator[pd.DataFrame], width: int, rows: int) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """day, packed rows and their matrix, at most so many rows of one day at a time."""
    for pdf in batches:
        for day, of_day in pdf.groupby("day", sort=True):
            for i in range(0, len(of_day), rows):
                part = of_day.iloc[i : i + rows]
                x = np.full((len(part), width), np.nan)
                for j, (col, value) in enumerate(zip(part["col"], part["value"])):
                    x[j, col] = value
                yield int(day), part, x


def _wide_days(packed: DataFrame, sizes: dict[int, int], width: int, step_s: int, rank: int, ridge: float, sweeps: int, rows: int, min_row: int, min_col: int) -> DataFrame:
    """The grid of days whose sources lie in many tasks; sizes: the sources of every such day."""

    def summed(factors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Sums over all sources of a day: of z and of readings a slot before there are factors, then its normal equations."""

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for day, _, x in _matrices(batches, width, rows):
                z, m, _, _ = _scaled(x)
                if factors:
                    part = np.hstack(_equations(z.T, m.T, _solved(*_equations(z, m, factors[day]), ridge)))
                else:
                    part = np.stack([z.sum(0), m.sum(0)], 1)
                total[day] = total[day] + part if day in total else part
            yield pd.DataFrame({"day": pd.Series(list(total), dtype="int64"), "part": [p.tobytes() for p in total.values()]})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            # In one order, whatever the order of arrival: sums of doubles depend on it.
            return pd.DataFrame({"day": pdf["day"].iloc[:1], "part": [sum(np.frombuffer(p) for p in sorted(pdf["part"])).tobytes()]})

        form = "day long, part binary"
        made = packed.mapInPandas(parts, form).groupBy("day").applyInPandas(added, form).collect()
        return {r["day"]: np.frombuffer(bytes(r["part"])).reshape(width, -1) for r in made}

    begin = summed({})
    n_col = {day: s[:, 1] for day, s in begin.items()}
    factors = {day: _start(s[:, 0], s[:, 1], sizes[day], rank) for day, s in begin.items()}
    last = factors
    for _ in range(sweeps):
        last, k = factors, {day: v.shape[1] for day, v in factors.items()}
        factors = {day: _solved(s[:, : k[day] ** 2], s[:, k[day] ** 2 :], ridge) for day, s in summed(last).items()}

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for day, part, x in _matrices(batches, width, rows):
            z, m, mean, sd = _scaled(x)
            u = _solved(*_equations(z, m, last[day]), ridge) if sweeps else np.zeros((len(x), last[day].shape[1]))
            fit = _fitted(u, factors[day], m, mean, sd, n_col[day], min_row, min_col)
            ends = [np.array([f(c) for c in part["col"]]) for f in (np.min, np.max)]
            yield _cells(part["source"].to_numpy(dtype=object), day * 86_400, step_s, x, *ends, fit)

    return packed.mapInPandas(fill, _GRID)


def regular_grid(
    readings: DataFrame,
    source: str,
    time: str,
    value: str,
    tie: str,
    step_s: int = 60,
    rank: int = 3,
    ridge: float = 0.5,
    sweeps: int = 12,
    block_sources: int = 64,
    min_row: int = 12,
    min_col: int = 2,
) -> DataFrame:
    """source, slot_start, value, status for every slot from the first to the last of a source's day."""
    day_s = 86_400
    reading = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value).cast("double"))
    slots = (
        readings.where(F.col(source).isNotNull() & F.col(time).isNotNull())
        .select(F.col(source).cast("string").alias("source"), (F.col(time) - F.pmod(time, F.lit(step_s))).alias("slot_start"), reading.alias("value"), F.col(tie).alias("tie"))
        .groupBy("source", "slot_start")
        .agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.coalesce("tie", F.lit(2**62)))).alias("value"))
    )
    day = F.floor(F.col("slot_start") / day_s)
    slots = slots.withColumn("day", day)
    placed = readings.where(F.col(time).isNotNull()).select(F.col(source).alias("source"), (F.col(time) - F.pmod(time, F.lit(step_s))).alias("slot_start"))
    of_day = placed.groupBy(day.alias("day")).agg(F.count_distinct("source").alias("n_sources"))
    sizes = {r["day"]: r["n_sources"] for r in of_day.where(F.col("n_sources") > block_sources).collect()}
    wide = F.broadcast(readings.sparkSession.createDataFrame([(d,) for d in sizes], "day long"))
    width = day_s // step_s

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        day = int(pdf["day"].iloc[0])
        place = {name: i for i, name in enumerate(sorted(set(pdf["source"])))}  # arrays of text would drop zero characters at an end
        names, row = np.array(list(place), dtype=object), np.array([place[s] for s in pdf["source"]])
        col = ((pdf["slot_start"].to_numpy() - day * day_s) // step_s).astype(np.int64)
        x = np.full((len(names), width), np.nan)
        x[row, col] = pdf["value"].to_numpy(dtype=np.float64)
        first, last = np.full(len(names), width), np.full(len(names), -1)
        np.minimum.at(first, row, col)
        np.maximum.at(last, row, col)
        return _cells(names, day * day_s, step_s, x, first, last, als_fill(x, rank, ridge, sweeps, min_row, min_col))

    narrow = slots.join(wide, "day", "left_anti") if sizes else slots
    grid = narrow.groupBy("day").applyInPandas(fill, _GRID)
    if sizes:
        cell = F.struct(((F.col("slot_start") - F.col("day") * day_s) / step_s).cast("int").alias("col"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
        of_wide = slots.join(wide, "day")
        packed = of_wide.repartitionByRange("day", "source").groupBy("day", "source").agg(F.collect_list(cell).alias("cells"))
        packed = stored(packed.select("day", "source", F.col("cells.col").alias("col"), F.col("cells.value").alias("value")))
        days = sorted(sizes)
        for some in (days[i : i + DAYS_AT_ONCE] for i in range(0, len(days), DAYS_AT_ONCE)):
            of_days = packed.where(F.col("day").between(some[0], some[-1]))
            grid = grid.unionAll(_wide_days(of_days, sizes, width, step_s, rank, ridge, sweeps, block_sources, min_row, min_col))
    return grid.withColumn("value", F.when(F.col("status") != UNSUPPORTED, F.col("value")))
