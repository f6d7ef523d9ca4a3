"""Implausible readings per source: impossible values, stuck runs and spikes.

Each (source, field) series of logarithms follows a local-level state-space
model whose observation noise is that source's own usual scatter. A Kalman
filter forecasts reading by reading; a standardised innovation above the
threshold is flagged and withheld from the update, so a spike doesn't move the
level. More than max_group successive flags are a change of level: the filter
starts anew there and the flags are lifted. What stays flagged is judged by its
two-sided innovation, against the forecast from before and the one that the same
filter makes backwards from the unflagged readings after it. A stuck sensor
shows in the innovations of the random walk on the values themselves: over
stuck_len readings their variance vanishes.

Scale: usual scatter comes from mergeable quantile sketches of the differences;
the filter runs on chunks of one day of one source, each with the last and
first `halo` readings of its neighbours, so no task ever sees more than a day
of a source however hot it is, and results don't depend on the chunk bounds
for runs and groups shorter than the halo. Copies are merged before anything is
placed by source; the ranked readings are written once and read twice.

Defined results: null and NaN are no readings; copies (same source and time)
count once, the smallest tie-break id wins; rows without source or time are
left out; zeros have no logarithm: they take no part in the filter and are
never spikes, but count for stuck runs; series with fewer than three positive
readings or without scatter get no spike flags; fields that never change get no
stuck flags; an empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.frames import frame
from telemill.session import stored


def kalman_flags(log_value: np.ndarray, minute: np.ndarray, sigma: float, drift: float, threshold: float, limit: float, max_group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Standardised innovation, flag, forecast and its variance for every reading of one series (all finite).

    The innovation is compared with its own scatter or, where a gap has made that large, with the limit.
    """
    n = len(log_value)
    z, flag, forecast, variance = np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n), np.ones(n)
    r, q = sigma * sigma, drift * sigma * sigma
    level, p, last, run = float(np.median(log_value[:9])), r, minute[0] if n else 0, []
    ys, ts, most = log_value.tolist(), minute.tolist(), limit * sigma
    for i in range(n):
        y = ys[i]
        p_prior = min(p + q * max(1.0, ts[i] - last), 25 * r)
        s = p_prior + r
        e = y - level
        z[i], forecast[i], variance[i] = e / math.sqrt(s), level, p_prior
        if abs(e) > min(threshold * math.sqrt(s), most):
            flag[i] = True
            run.append(i)
            if len(run) > max_group:
                level, p, last = float(np.median(log_value[run])), r, ts[i]
                flag[run] = False
                run = []
            continue
        gain = p_prior / s
        level += gain * e
        p, last, run = (1 - gain) * p_prior, ts[i], []
    return z, flag, forecast, variance


def two_sided(log_value: np.ndarray, minute: np.ndarray, flag: np.ndarray, forecast: np.ndarray, variance: np.ndarray, sigma: float, drift: float, ahead: int) -> np.ndarray:
    """Deviation, in usual scatters, of every flagged reading from the forecasts of both directions.

    Backwards the filter runs over the next `ahead` unflagged readings; older ones have no weight left by then.
    """
    out = np.zeros(len(log_value))
    r, q = sigma * sigma, drift * sigma * sigma
    plain = np.flatnonzero(~flag)
    ys, ts = log_value.tolist(), minute.tolist()
    for i in np.flatnonzero(flag).tolist():
        at = int(np.searchsorted(plain, i))
        after = plain[at : at + ahead].tolist()[::-1]
        if at + len(after) < 3:
            continue
        level, weight = 0.0, 0.0
        if at:
            weight = 1 / variance[i]
            level = forecast[i] * weight
        if after:
            back, p, last = ys[after[0]], r, ts[after[0]]
            for j in after[1:]:
                p_prior = min(p + q * max(1.0, last - ts[j]), 25 * r)
                gain = p_prior / (p_prior + r)
                back += gain * (ys[j] - back)
                p, last = (1 - gain) * p_prior, ts[j]
            p = min(p + q * max(1.0, last - ts[i]), 25 * r)
            level, weight = level + back / p, weight + 1 / p
        out[i] = (ys[i] - level / weight) / sigma
    return out


def stuck_readings(value: np.ndarray, length: int) -> np.ndarray:
    """Readings in a stretch of at least `length` over which the innovations of the random walk have no variance."""
    out = np.zeros(len(value), dtype=bool)
    if len(value) < length or length < 2:
        return out
    with np.errstate(invalid="ignore", over="ignore"):
        e = np.diff(value)
        largest = np.max(np.abs(e), where=np.isfinite(e), initial=0.0) or 1.0
        square = np.where(e == 0, 0.0, np.maximum(np.nan_to_num(np.abs(e) / largest, nan=1.0), 1e-150) ** 2)
    still = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(square, length - 1).max(axis=1) == 0)
    for shift in range(length):
        out[still + shift] = True
    return out


def flag_readings(
    readings: DataFrame,
    source: str,
    time: str,
    impossible: dict[str, Column],
    tie: str,
    carry: tuple[str, ...] = (),
    chunk_s: int = 86_400,
    halo: int = 64,
    drift: float = 0.05,
    threshold: float = 4.5,
    limit: float = 6.0,
    max_group: int = 4,
    stuck_len: int = 10,
    ahead: int = 24,
) -> DataFrame:
    """The flagged readings: source, time, field, value, impossible, stuck, spike, innovation, deviation.

    impossible: by field, the condition (over the fields and the carried columns) that a reading cannot be right.
    """
    fields = list(impossible)
    valid = lambda f: F.col(f).isNotNull() & ~F.isnan(f)
    once = (
        readings.where(F.col(source).isNotNull() & F.col(time).isNotNull())
        .select(F.col(source).alias("source"), F.col(time).cast("long").alias("time"), F.col(tie).alias("tie"), *[F.col(f).cast("double").alias(f"f_{f}") for f in [*fields, *carry]])
        # Copies meet on the map side first: a source and day with a third of all rows is a day's readings afterwards.
        .groupBy("source", "time")
        .agg(*[F.min_by(f"f_{f}", F.when(valid(f"f_{f}"), F.coalesce(F.col("tie"), F.lit(2**62)))).alias(f) for f in [*fields, *carry]])
        .withColumns({f"bad_{f}": F.when(F.col(f).isNotNull(), F.coalesce(impossible[f] | (F.abs(f) == float("inf")), F.lit(False))) for f in fields})
        .withColumn("chunk", F.floor(F.col("time") / chunk_s))
        .drop(*carry)
    )
    in_chunk = Window.partitionBy("source", "chunk").orderBy("time")
    good_log = lambda f: F.when(~F.col(f"bad_{f}") & (F.col(f) > 0), F.ln(f))
    ranked = once.withColumns(
        {"rank": F.row_number().over(in_chunk), "rank_end": F.count(F.lit(1)).over(Window.partitionBy("source", "chunk"))} | {f"step_{f}": F.abs(good_log(f) - F.lag(good_log(f)).over(in_chunk)) for f in fields}
    ).withColumn("rank_end", F.col("rank_end") - F.col("rank") + 1)
    ranked = stored(ranked)

    # Per source: usual scatter (median absolute step of the logarithms) and whether a field ever changes.
    usual = ranked.groupBy("source").agg(
        *[F.percentile_approx(F.when(F.col(f"step_{f}") > 0, F.col(f"step_{f}")), 0.5, 10_000).alias(f"mid_{f}") for f in fields],
        *[(F.min(F.when(~F.col(f"bad_{f}"), F.col(f))) < F.max(F.when(~F.col(f"bad_{f}"), F.col(f)))).alias(f"varies_{f}") for f in fields],
    )
    sigma = {f"sigma_{f}": F.coalesce(F.col(f"mid_{f}") * (1.4826 / math.sqrt(2)), F.lit(0.0)) for f in fields}
    by_chunk = Window.partitionBy("source").orderBy("chunk")
    chunks = (
        ranked.groupBy("source", "chunk").agg(F.lit(1).alias("one")).drop("one")
        .withColumns({"chunk_before": F.lag("chunk").over(by_chunk), "chunk_after": F.lead("chunk").over(by_chunk)})
        .join(usual.withColumns(sigma), "source")
        .select("source", "chunk", "chunk_before", "chunk_after", *sigma, *[f"varies_{f}" for f in fields])
    )
    placed = (
        ranked.drop(*[f"step_{f}" for f in fields])
        .join(chunks, ["source", "chunk"])
        .withColumn(
            "to",
            F.array_compact(F.array(
                F.col("chunk"),
                F.when(F.col("rank") <= halo, F.col("chunk_before")),
                F.when(F.col("rank_end") <= halo, F.col("chunk_after")),
            )),
        )
        .select("source", "chunk", "time", *fields, *[f"bad_{f}" for f in fields], *sigma, *[f"varies_{f}" for f in fields], F.explode("to").alias("task"))
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        core_all, time_all = (pdf["chunk"] == pdf["task"]).to_numpy(), pdf["time"].to_numpy()
        parts = []
        for f in fields:
            have = pdf[f].notna().to_numpy()
            if not have.any():
                continue
            value, at, core = pdf[f].to_numpy(dtype=np.float64)[have], time_all[have], core_all[have]
            bad = pdf[f"bad_{f}"].to_numpy()[have].astype(bool)
            sd, varies = float(pdf[f"sigma_{f}"].iloc[0]), bool(pdf[f"varies_{f}"].iloc[0] or False)
            stuck = stuck_readings(value, stuck_len) & varies
            z, deviation, spike = np.zeros(len(value)), np.zeros(len(value)), np.zeros(len(value), dtype=bool)
            ok = np.flatnonzero(~bad & (value > 0))
            if sd > 0 and len(ok) >= 3:
                logs, minute = np.log(value[ok]), at[ok] / 60.0
                z[ok], flag, *forecast = kalman_flags(logs, minute, sd, drift, threshold, limit, max_group)
                deviation[ok] = two_sided(logs, minute, flag, *forecast, sd, drift, ahead)
                spike = np.abs(deviation) > limit
            hit = (bad | stuck | spike) & core
            parts.append((at[hit], np.full(hit.sum(), f, dtype=object), value[hit], bad[hit], stuck[hit], spike[hit], z[hit], deviation[hit]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 8
        names = ("time", "field", "value", "impossible", "stuck", "spike", "innovation", "deviation")
        return frame({"source": pdf["source"].iloc[0]} | dict(zip(names, columns)))

    return placed.groupBy("source", "task").applyInPandas(
        score, "source string, time long, field string, value double, impossible boolean, stuck boolean, spike boolean, innovation double, deviation double"
    )
