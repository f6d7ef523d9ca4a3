"""JSON logs: typed fields out of free-form objects, and one summary row per service and window.

A summary reads its logs once: every record gives a few (kind, value) cells that
are counted by service, window and value with map-side combine; totals, errors,
distinct users, top-k and percentiles come from those counts.

Defined results: malformed lines and values that aren't objects yield no record;
missing or empty categorical values are not counted; a window without numeric
values has percentiles 0; ties in a top-k go to the smaller value; null services
are "unknown"; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.columns import fixed, non_blank, plain_number, window_start
from telemill.functions.percentiles import group_percentiles

#: Keys that may name the service, levels of errors, fields that may name a user.
SERVICE_KEYS = ("service.name", "svc", "app", "application")
ERROR_LEVELS = ("error", "fatal")
USER_KEYS = ("user_id", "uid", "user", "customer_id", "account_id")
#: Kinds of cells; the fields of top-k lists follow from 0 on.
_RECORD, _USER, _VALUE = -1, -2, -3
_GROUP = ("service", "window_start")


def parse_object(body: Column) -> Column:
    """VARIANT of a JSON object; null for malformed text, arrays and scalars."""
    text = F.trim(body)
    return F.when(text.startswith("{"), F.try_parse_json(text))


def member(v: Column, key: str) -> Column:
    """A top-level member; keys may hold dots."""
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def scalar_text(value: Column) -> Column:
    """Text of a string or number; null for booleans, null, arrays and objects."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "BIGINT", F.try_variant_get(value, "$", "string")).when(is_number, plain_number(number))


def service_of(v: Column, service_field: str = "service") -> Column:
    """The first key that is present as string or number decides; if it is empty the service is unknown."""
    present = F.coalesce(*[scalar_text(member(v, k)) for k in (service_field, *SERVICE_KEYS)])
    return F.coalesce(non_blank(present), F.lit("unknown"))


def first_field(v: Column, keys: Sequence[str]) -> Column:
    """The first non-empty string or number among keys."""
    return F.coalesce(*[non_blank(scalar_text(member(v, k))) for k in keys])


def numeric_field(v: Column, key: str) -> Column:
    """A number, or a string that reads as one; null otherwise."""
    value = member(v, key)
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string").try_cast("double")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))


def is_error(level: Column, levels: Sequence[str] = ERROR_LEVELS) -> Column:
    return F.coalesce(F.lower(level).isin(*[x.lower() for x in levels]), F.lit(False))


def windowed(logs: DataFrame, seconds: int) -> DataFrame:
    """logs (service, ts and more) with window_start; null services become unknown."""
    return logs.withColumn("service", F.coalesce(non_blank(F.col("service")), F.lit("unknown"))).withColumn("window_start", window_start(F.col("ts"), seconds))


def cells(logs: DataFrame, seconds: int, fields: Sequence[str] = (), value: str | None = "latency_ms", level: str | None = "level", user: str | None = "user", levels: Sequence[str] = ERROR_LEVELS) -> DataFrame:
    """service, window_start, kind, text, number, n, errors: the counts of everything a summary needs."""
    cell = lambda kind, text=None, number=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if number is None else number).cast("double").alias("number"))
    failed = is_error(F.col(level), levels) if level else F.lit(False)
    made = [cell(_RECORD)]
    if user:
        made.append(F.when(non_blank(F.col(user)).isNotNull(), cell(_USER, F.col(user))))
    if value:
        made.append(F.when(F.col(value).isNotNull(), cell(_VALUE, number=F.col(value))))
    made += [F.when(non_blank(F.col(f)).isNotNull(), cell(i, F.col(f))) for i, f in enumerate(fields)]
    spread = windowed(logs, seconds).select(*_GROUP, F.when(failed, 1).otherwise(0).alias("failed"), F.explode(F.array_compact(F.array(*made))).alias("c"))
    return spread.groupBy(*_GROUP, "c.kind", "c.text", "c.number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("c.kind") == _RECORD, F.col("failed")).otherwise(0)).alias("errors"))


def _totals(counted: DataFrame, seconds: int) -> DataFrame:
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0)).cast("long")
    sums = counted.groupBy(*_GROUP).agg(of(_RECORD, F.col("n")).alias("count"), of(_RECORD, F.col("errors")).alias("errors"), of(_USER, F.lit(1)).alias("unique_users"))
    points = group_percentiles(counted.where(F.col("kind") == _VALUE), _GROUP, "number", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return sums.join(points, list(_GROUP), "left").select(
        *_GROUP, (F.col("window_start") + seconds).alias("window_end"), "count", (F.col("count") / F.lit(float(seconds))).alias("rps"), (F.col("errors") / F.col("count")).alias("error_rate"),
        *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")], "unique_users",
    )


def totals(logs: DataFrame, seconds: int, value: str = "latency_ms", level: str = "level", user: str | None = "user", levels: Sequence[str] = ERROR_LEVELS) -> DataFrame:
    """service, window_start, window_end, count, rps, error_rate, p50, p95, p99 and unique_users."""
    return _totals(cells(logs, seconds, (), value, level, user, levels), seconds)


def _top(counted: DataFrame, limit: int) -> DataFrame:
    """service, window_start, kind, top: "value:n,value:n" of the most frequent values of every field."""
    ranked = counted.where(F.col("kind") >= 0).withColumn("place", F.row_number().over(Window.partitionBy(*_GROUP, "kind").orderBy(F.desc("n"), "text"))).where(F.col("place") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "text", "n").alias("t"))))
    return ranked.groupBy(*_GROUP, "kind").agg(F.array_join(F.transform(pairs, lambda p: p["t"]), ",").alias("top"))


def top_k(logs: DataFrame, seconds: int, field: str, limit: int = 5) -> DataFrame:
    """service, window_start, top: "value:n,value:n" of the most frequent values of a field."""
    return _top(cells(logs, seconds, [field], None, None, None), limit).drop("kind")


def reservoir(logs: DataFrame, seconds: int, value: str = "latency_ms", cap: int = 256, seed: int = 0) -> DataFrame:
    """service, window_start, value: a seeded sample of at most cap values of every group, the same on every run.

    A sample is what is asked for here; the percentiles of a summary use every value.
    """
    key = [F.col(c) for c in sorted(logs.columns)]
    placed = windowed(logs, seconds).where(F.col(value).isNotNull()).withColumn("__h", F.xxhash64(F.lit(seed), F.to_json(F.struct(*key))))
    chosen = placed.withColumn("__place", F.row_number().over(Window.partitionBy(*_GROUP).orderBy("__h", value))).where(F.col("__place") <= cap)
    return chosen.select(*_GROUP, F.col(value).cast("double").alias("value"))


def summarize(logs: DataFrame, seconds: int, fields: Sequence[str] | dict[str, str], value: str = "latency_ms", user: str | None = "user", limit: int = 5, levels: Sequence[str] = ERROR_LEVELS) -> DataFrame:
    """Aggregate rows (labels, summary) of logs: top_<field> and unique_users labels, text with the first top-k.

    fields may name the column of each field where that has another name.
    """
    columns = dict(fields) if isinstance(fields, dict) else {f: f for f in fields}
    counted = cells(logs, seconds, list(columns.values()), value, user=user, levels=levels)
    out = _totals(counted, seconds)
    names = [f"top_{f}" for f in columns]
    if columns:
        of = lambda i: F.max(F.when(F.col("kind") == i, F.col("top")))
        out = out.join(_top(counted, limit).groupBy(*_GROUP).agg(*[of(i).alias(f"__t{i}") for i in range(len(names))]), list(_GROUP), "left")
    tops = [F.col(f"__t{i}") for i in range(len(names))]
    values = [*tops, F.when(F.col("unique_users") > 0, F.col("unique_users").cast("string")), F.lit("logs")]
    labels = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in [*names, "unique_users", "source"]]), F.array(*values)), lambda k, v: v.isNotNull())
    first = F.coalesce(F.concat(F.lit(f" {names[0]}="), tops[0]), F.lit("")) if names else F.lit("")
    text = F.concat(F.format_string("logs summary: service=%s total=%d error_rate=", "service", "count"), fixed(F.col("error_rate"), 4), first)
    return out.select(
        "service", "window_start", "window_end", labels.alias("labels"), F.lit("{}").alias("locator"), "count", "rps", "error_rate", "p50", "p95", "p99",
        F.lit(0.0).alias("anomaly_score"), text.alias("summary"), F.lit(None).cast("array<float>").alias("vector"),
    )
