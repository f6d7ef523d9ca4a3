"""Column helpers: blanks, windows, fixed notation, safe lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_blank(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(*candidates: Column, default: str | None = None) -> Column:
    """The first candidate that is neither null nor empty."""
    out = [non_blank(c) for c in candidates]
    return F.coalesce(*out, F.lit(default)) if default is not None else F.coalesce(*out)


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of a Unix time."""
    return ts - F.pmod(ts, F.lit(seconds))


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text, as %.<digits>f."""
    return F.format_string(f"%.{digits}f", c)


def plain_number(c: Column) -> Column:
    """Shortest plain text of a double, never in scientific notation: 100, 0.5, 12345678.5."""
    text = c.cast("string")
    return F.when(text.contains("E"), F.regexp_replace(F.regexp_replace(F.format_string("%.9f", c), "0+$", ""), r"\.$", "")).otherwise(F.regexp_replace(text, r"\.0$", ""))


def trimmed_number(c: Column) -> Column:
    """%.6f without trailing zeros and point."""
    return F.regexp_replace(F.regexp_replace(fixed(c, 6), "0+$", ""), r"\.$", "")


def unix_seconds(ntz: Column) -> Column:
    """Whole Unix seconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def percentiles(value: Column, points: Sequence[float], frequency: Column | None = None) -> list[Column]:
    """Exact percentiles with linear interpolation at q (n - 1); 0 without values."""
    one = lambda q: F.percentile(value, F.lit(q), frequency) if frequency is not None else F.percentile(value, F.lit(q))
    return [F.coalesce(one(q), F.lit(0.0)) for q in points]


def number_value(c: Column) -> Column:
    """Truncation of max(v, 0) towards zero, as a count."""
    return F.floor(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).cast("long")


def fenced(c: Column) -> Column:
    """The value as a column that the optimizer computes once: a long expression isn't copied into each of its uses.

    The condition always holds; being non-deterministic, it keeps filters and projections from being pushed through.
    """
    return F.when(F.spark_partition_id() >= 0, c)
