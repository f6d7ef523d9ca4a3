"""Metric points and Prometheus samples to one summary row per service and window.

One hash aggregation by (service, window); histogram buckets enter an exact
weighted percentile, so no samples are materialised. Error points count as
requests and errors again, and count adds requests, errors and samples: both are
deliberate in the result's definition. Services without any usable metric give a
row of zeros.

Defined results: values are null -> 0; NaN samples are dropped; the overflow
bucket is no sample; cumulative counters that fall count 0; empty inputs give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.columns import first_filled, fixed, non_blank, number_value, percentiles, ratio, window_start


def unnest(metrics: DataFrame, column: str = "resource_metrics") -> DataFrame:
    """One row a data point out of resource -> scope -> metric -> points; other metric types give rows without value."""
    r = metrics.select(F.explode(column).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scope_metrics").alias("s"))
    m = s.select("resource", F.explode("s.metrics").alias("m"))
    labels = lambda p: F.map_from_entries(F.transform(p["attributes"], lambda a: F.struct(a["k"], a["v"])))
    value = lambda p: F.coalesce(p["as_double"], p["as_int"].cast("double"), F.lit(0.0))
    none_d, none_l = F.lit(None).cast("array<double>"), F.lit(None).cast("array<long>")
    shape = lambda p, v, b, c: F.struct(labels(p).alias("labels"), v.alias("value"), b.alias("bounds"), c.alias("counts"), p["time_unix_nano"].alias("time_unix_nano"))
    sums = F.transform("m.sum.points", lambda p: shape(p, value(p), none_d, none_l))
    hists = F.transform("m.histogram.points", lambda p: shape(p, F.lit(None).cast("double"), p["explicit_bounds"], p["bucket_counts"]))
    return (
        m.select("resource", "m.name", F.col("m.type").alias("kind"), F.when(F.col("m.type") == "sum", F.col("m.sum.temporality")).otherwise(F.col("m.histogram.temporality")).alias("temporality"), F.explode_outer(F.when(F.col("m.type") == "sum", sums).when(F.col("m.type") == "histogram", hists)).alias("p"))
        .select("resource", "name", "kind", "temporality", "p.labels", "p.value", "p.bounds", "p.counts", "p.time_unix_nano")
    )


def is_ok(code: Column) -> Column:
    """ok, unset and anything that starts with 2."""
    c = F.lower(code)
    return c.isin("ok", "unset") | c.startswith("2")


def series_key(name: Column, resource: Column, labels: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.concat_ws("|", name, F.coalesce(resource["service.name"], F.lit("")), F.array_join(pairs, "|"))


def previous(rows: DataFrame, series: str, time: str, ties: list[str], values: list[str], chunk: int) -> DataFrame:
    """rows with before: the struct of values of the row before in its series, null for the first.

    A series is walked in chunks of its time; the last row of a chunk is handed to the next one, so a series
    that holds a third of all rows is as many tasks as chunks.
    """
    order = [time, *ties]
    cut = rows.withColumn("__chunk", F.floor(F.col(time) / chunk)).withColumn("__now", F.struct(*[F.col(v) for v in values]))
    in_chunk = Window.partitionBy(series, "__chunk").orderBy(*order)
    walked = cut.withColumns({"__lag": F.lag("__now").over(in_chunk), "__last": F.lead("__now").over(in_chunk).isNull()})
    lasts = walked.where("__last").select(F.col(series).alias("__s"), F.col("__chunk").alias("__c"), "__now")
    carried = lasts.select("__s", "__c", F.lag("__now").over(Window.partitionBy("__s").orderBy("__c")).alias("__carried")).where("__carried IS NOT NULL")
    joined = walked.join(carried, F.col(series).eqNullSafe(F.col("__s")) & F.col("__chunk").eqNullSafe(F.col("__c")), "left")
    return joined.select(*rows.columns, F.coalesce("__lag", "__carried").alias("before"))


#: Length of a chunk of a series, in the units of its time (nanoseconds of a day).
DAY_NANOS = 86_400 * 10**9


def counter_delta(rows: DataFrame, series: str, order: list[str], value: str, out: str = "delta", chunk: int = DAY_NANOS) -> DataFrame:
    """max(current - previous, 0) along each series; the first point counts in full, a reset counts 0.

    order: time and tie-breaks; chunk in the units of that time.
    """
    walked = previous(rows, series, order[0], order[1:], [value], chunk)
    return walked.withColumn(out, F.greatest(F.col(value) - F.coalesce(F.col("before")[value], F.lit(0.0)), F.lit(0.0))).drop("before")


def to_delta(points: DataFrame, slot=None) -> DataFrame:
    """Points with cumulative sums and histogram buckets turned into deltas.

    slot (get, put): the last point of every series of earlier calls, on streams.
    """
    keyed = points.withColumn("series", series_key(F.col("name"), F.col("resource"), F.col("labels")))
    if slot is not None:
        before, keyed = slot.get(), keyed.withColumn("__old", F.lit(False))
        keyed = keyed if before is None else keyed.unionByName(before)
        last = F.max_by(F.struct(*[c for c in keyed.columns if c != "__old"], F.lit(True).alias("__old")), F.coalesce(F.col("time_unix_nano").cast("long"), F.lit(-(2**63))))
        slot.put(keyed.groupBy(F.col("series").alias("__series")).agg(last.alias("p")).select("p.*"))
    walked = previous(keyed, "series", "time_unix_nano", [], ["value", "counts"], DAY_NANOS)
    before, total = F.col("before"), F.col("temporality") == 2
    bucket = F.transform("counts", lambda c, i: F.greatest(c - F.coalesce(F.try_element_at(before["counts"], i + 1), F.lit(0)), F.lit(0)))
    made = walked.withColumns({"value": F.when(total, F.greatest(F.col("value") - F.coalesce(before["value"], F.lit(0.0)), F.lit(0.0))).otherwise(F.col("value")), "counts": F.when(total, bucket).otherwise(F.col("counts"))}).drop("series", "before")
    return made if slot is None else made.where(~F.col("__old")).drop("__old")


def _rows(grouped: DataFrame, seconds: int, source: str) -> DataFrame:
    """Aggregate rows out of service, window_start, req, ok, err, count, p50, p95, p99."""
    with_rates = grouped.withColumns({"rps": F.col("req") / F.lit(float(seconds)), "error_rate": ratio(F.col("err"), F.col("ok") + F.col("err"))})
    text = F.concat(F.format_string("summary service=%s rps=", "service"), fixed(F.col("rps"), 6), F.lit(" error_rate="), fixed(F.col("error_rate"), 6), F.format_string(" count=%d", "count"))
    return with_rates.select(
        "service", "window_start", (F.col("window_start") + seconds).alias("window_end"), F.create_map(F.lit("source"), F.lit(source)).alias("labels"), F.lit("{}").alias("locator"), "count", "rps", "error_rate", "p50", "p95", "p99",
        F.lit(0.0).alias("anomaly_score"), text.alias("summary"), F.lit(None).cast("array<float>").alias("vector"),
    )


def summarize_points(points: DataFrame, seconds: int = 60, sample_cap: int = 50, service_attribute: str = "service.name", source: str = "metrics") -> DataFrame:
    """Aggregate rows of delta points."""
    service = first_filled(F.col("resource")[service_attribute], F.col("resource")["service"], F.col("resource")["service.name"], default="unknown")
    label = lambda k: non_blank(F.col("labels")[k])
    code = F.coalesce(label("status.code"), label("status_code"))
    v = F.coalesce(F.col("value"), F.lit(0.0))
    requests, errors = (F.col("kind") == "sum") & F.col("name").endswith("requests_total"), (F.col("kind") == "sum") & F.col("name").endswith("errors_total")
    failed = code.isNotNull() & ~is_ok(code)
    # Buckets that hold samples, each capped per data point; the overflow bucket has no bound and drops out.
    zipped = F.filter(F.arrays_zip("bounds", "counts"), lambda b: b["bounds"].isNotNull() & (b["counts"] > 0))
    rows = points.select(
        service.alias("service"), window_start(F.floor(F.col("time_unix_nano") / 1_000_000_000), seconds).alias("window_start"),
        F.when(requests, v).otherwise(0.0).alias("req_v"), F.when(errors, v).otherwise(0.0).alias("err_v"),
        F.when(requests & failed, v).otherwise(0.0).alias("bad_v"),
        (F.when(requests, number_value(v)).otherwise(0) + F.when(errors, number_value(v)).otherwise(0)).alias("n"),
        F.when(F.col("kind") == "histogram", zipped).alias("buckets"),
    )
    first = rows.select("*", F.posexplode_outer("buckets").alias("i", "b")).withColumn("lead", F.coalesce(F.col("i"), F.lit(0)) == 0)
    reps = F.when(F.col("b.counts").isNotNull(), F.least(F.col("b.counts"), F.lit(sample_cap))).cast("long")
    once = lambda c: F.sum(F.when(F.col("lead"), F.col(c)).otherwise(0))
    p = percentiles(F.col("b.bounds"), (0.5, 0.95, 0.99), F.coalesce(reps, F.lit(0)))
    grouped = first.groupBy("service", "window_start").agg(
        (once("req_v") + once("err_v")).alias("req"), (once("req_v") - once("bad_v")).alias("ok"), (once("bad_v") + once("err_v")).alias("err"),
        (once("n") + F.sum(F.coalesce(reps, F.lit(0)))).alias("count"), p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"),
    )
    return _rows(grouped, seconds, source)


def summarize_prometheus(samples: DataFrame, seconds: int = 60, sample_cap: int = 50, service_label: str = "service.name") -> DataFrame:
    """Aggregate rows of remote-write samples (labels, value, ts_ms)."""
    label = lambda k: non_blank(F.col("labels")[k])
    name = F.coalesce(F.col("labels")["__name__"], F.lit(""))
    service = first_filled(F.col("labels")[service_label], F.col("labels")["service.name"], F.col("labels")["service"], F.col("labels")["job"], default="unknown")
    is_bucket = name.endswith("_duration_seconds_bucket")
    is_request = ~is_bucket & name.endswith("_requests_total")
    is_failure = ~is_bucket & ~is_request & name.endswith("_errors_total")
    code = F.coalesce(label("status_code"), label("code"))
    v = F.greatest(F.col("value"), F.lit(0.0))
    le = F.when(is_bucket, F.col("labels")["le"].try_cast("double"))
    usable = le.isNotNull()
    rows = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        service.alias("service"), window_start(F.floor(F.col("ts_ms") / 1000), seconds).alias("window_start"),
        F.when(is_request | is_failure, v).otherwise(0.0).alias("req"),
        F.when(is_request & (code.isNull() | is_ok(code)), v).otherwise(0.0).alias("ok"),
        F.when(is_failure | (is_request & code.isNotNull() & ~is_ok(code)), v).otherwise(0.0).alias("err"),
        F.when(is_request | is_failure | usable, number_value(v)).otherwise(0).alias("n"),
        le.alias("le"), F.when(usable, F.floor(F.least(v, F.lit(float(sample_cap))))).otherwise(0).cast("long").alias("reps"),
    )
    p = percentiles(F.col("le"), (0.5, 0.95, 0.99), F.col("reps"))
    grouped = rows.groupBy("service", "window_start").agg(*[F.sum(c).alias(c) for c in ("req", "ok", "err")], F.sum("n").alias("count"), p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"))
    return _rows(grouped, seconds, "metrics")
