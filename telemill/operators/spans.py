"""Spans to request, error and duration metrics.

Spans come nested (resource, scope, span) or flat; points are typed rows, never
re-serialised. Defined results: an end before the start counts as no duration,
a missing end as now; attributes that are empty are absent; null events are no
events; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.columns import first_filled, non_blank
from telemill.schema import DURATION_BOUNDS

_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
_STATUS = ("unset", "ok", "error")


def unnest(traces: DataFrame, column: str = "resource_spans") -> DataFrame:
    """One row a span out of resource -> scope -> span arrays."""
    r = traces.select(F.explode(column).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scope_spans").alias("s"))
    x = s.select("resource", F.explode("s.spans").alias("x"))
    return x.select("resource", "x.attributes", "x.kind", F.col("x.status.code").alias("status_code"), F.col("x.start_time_unix_nano").alias("start_unix_nano"), F.col("x.end_time_unix_nano").alias("end_unix_nano"), "x.events")


def duration_seconds(start: Column, end: Column) -> Column:
    now = F.unix_micros(F.current_timestamp()) * 1000
    closed = F.when(F.coalesce(end, F.lit(0)) == 0, now).otherwise(end)
    return (F.greatest(closed, start) - start) / 1e9


def bucket_index(value: Column, bounds: Sequence[float] = DURATION_BOUNDS) -> Column:
    """The first i with value <= bounds[i], else len(bounds); NaN falls into bucket 0."""
    return F.when(F.isnan(value), F.lit(0)).otherwise(F.size(F.filter(F.lit(list(bounds)), lambda b: b < value)))


def is_error(status_errors: bool = True, event_names: Sequence[str] = ("exception",)) -> Column:
    names = [n.lower() for n in event_names]
    by_event = F.coalesce(F.exists("events", lambda e: F.lower(e["name"]).isin(*names)), F.lit(False)) if names else F.lit(False)
    return (F.coalesce(F.col("status_code") == 2, F.lit(False)) if status_errors else F.lit(False)) | by_event


def service_of(attribute: str = "service.name") -> Column:
    r = F.col("resource")
    return first_filled(r[attribute], r["service"], r["service.name"], default="unknown")


def _named(code: Column, names: Sequence[str]) -> Column:
    return F.try_element_at(F.lit(list(names)), F.coalesce(code, F.lit(0)) + 1)


def dimensions(keys: Sequence[str]) -> Column:
    """span.kind and status.code, then each key from the span or its resource, then service.name."""
    entries = [(F.lit("span.kind"), _named(F.col("kind"), _KINDS)), (F.lit("status.code"), _named(F.col("status_code"), _STATUS))]
    entries += [(F.lit(k), F.coalesce(non_blank(F.col("attributes")[k]), non_blank(F.col("resource")[k]))) for k in keys if k != "service.name"]
    entries.append((F.lit("service.name"), non_blank(F.col("resource")["service.name"])))
    return F.map_filter(F.map_from_arrays(F.array(*[k for k, _ in entries]), F.array(*[v for _, v in entries])), lambda k, v: v.isNotNull())


def error_labels(event_names: Sequence[str], attributes: Sequence[str]) -> Column:
    """The requested attributes of the first error event that has any of them."""
    names = [n.lower() for n in event_names]
    picked = F.transform(F.filter("events", lambda e: F.lower(e["name"]).isin(*names)), lambda e: F.map_filter(e["attributes"], lambda k, v: k.isin(*attributes) & (v != "")))
    return F.coalesce(F.try_element_at(F.filter(picked, lambda m: F.size(m) > 0), F.lit(1)), F.create_map().cast("map<string,string>"))


def to_points(spans: DataFrame, keys: Sequence[str] = (), bounds: Sequence[float] = DURATION_BOUNDS, event_names: Sequence[str] = ("exception",), error_attributes: Sequence[str] = ("exception.type",), status_errors: bool = True) -> DataFrame:
    """requests_total, errors_total and duration_seconds points of spans, all delta."""
    at = bucket_index(F.col("duration"), bounds)
    prepared = spans.withColumn("duration", duration_seconds(F.col("start_unix_nano"), F.col("end_unix_nano"))).withColumns({"labels": dimensions(keys), "failed": is_error(status_errors, event_names), "at": at})
    none_d, none_l = F.lit(None).cast("array<double>"), F.lit(None).cast("array<long>")
    labels = F.col("labels")
    wider = F.map_concat(F.map_filter(labels, lambda k, v: ~k.isin(*error_attributes)), error_labels(event_names, error_attributes)) if error_attributes else labels
    one = lambda name, kind, lab, value, b, c: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), lab.alias("labels"), value.alias("value"), b.alias("bounds"), c.alias("counts"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda i: F.when(i == F.col("at"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    made = F.array_compact(F.array(
        one("requests_total", "sum", labels, F.lit(1.0), none_d, none_l),
        F.when(F.col("failed"), one("errors_total", "sum", wider, F.lit(1.0), none_d, none_l)),
        one("duration_seconds", "histogram", labels, F.lit(None).cast("double"), F.lit(list(bounds)), counts),
    ))
    return prepared.select("resource", F.explode(made).alias("p"), F.greatest("end_unix_nano", "start_unix_nano").alias("time_unix_nano")).select("resource", "p.name", "p.kind", F.lit(1).alias("temporality"), "p.labels", "p.value", "p.bounds", "p.counts", "time_unix_nano")
