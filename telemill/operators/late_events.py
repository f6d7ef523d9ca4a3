"""Event-time aggregates that are corrected as late records arrive.

Records fall into cells of a triangle: event period by arrival period. A cell is
aggregated once; a running sum over the arrival periods of an event period
gives every corrected revision of its count and of the sums of its measures. Records beyond the cut-off are
filtered before the triangle. Everything is Spark SQL; the only shuffles are
the one that removes copies and the one that builds the cells (pre-aggregated
on the map side, so one hot source or period does not meet in one task).

Defined results: null or unreadable event times take the arrival; rows without
a record id or an arrival hold no record; records that arrive before their
event count as on time; repeated copies count once, at their first arrival;
an empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a Unix time decide its unit: below these values it is s, ms, us, else ns.
_UNIT_LIMITS = ((1e11, 0), (1e14, 3), (1e17, 6))
_ISO = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?\s*(Z|z|[+-]\d{2}:?\d{2})?\s*$"


def readable_seconds(text: Column) -> Column:
    """Whole Unix seconds of a time given as number (s, ms, us, ns) or ISO text; null if unreadable."""
    number = text.try_cast("decimal(38,6)")
    scaled = F.when(number < 1e11, number)
    for limit, digits in _UNIT_LIMITS[1:]:
        scaled = scaled.when(number < limit, number / F.lit(10**digits))
    scaled = scaled.otherwise(number / F.lit(10**9))
    iso = F.when(text.rlike(_ISO), F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    return F.when(number > 0, F.floor(scaled).cast("long")).otherwise(F.floor(F.unix_micros(iso) / 1_000_000).cast("long"))


def json_log_records(envelopes: DataFrame) -> DataFrame:
    """record_id, service, arrival, event, failed, latency_ms of every record in the json_logs bodies, copies merged."""
    body = F.trim(F.col("bytes").cast("string"))
    parsed = (
        envelopes.where((F.col("kind") == "json_logs") & F.col("bytes").isNotNull() & F.col("ts_unix").isNotNull())
        .select("ts_unix", body.alias("body"))
        .where(F.col("body").startswith("{") & F.col("body").endswith("}"))
        .select("ts_unix", F.try_parse_json("body").alias("v"))
        .where(F.col("v").isNotNull())
    )
    get = lambda key: F.try_variant_get("v", f"$.{key}", "string")
    fields = parsed.select(
        get("rid").alias("record_id"),
        F.col("ts_unix").alias("arrival"),
        F.coalesce(F.nullif(get("service"), F.lit("")), F.lit("unknown")).alias("service"),
        F.coalesce(readable_seconds(get("ts")), readable_seconds(get("timestamp_unix_nano"))).alias("event"),
        F.when(F.lower(get("level")).isin("error", "fatal"), 1).otherwise(0).alias("failed"),
        F.try_variant_get("v", "$.latency_ms", "double").alias("latency_ms"),
    ).where(F.col("record_id").isNotNull())
    first = fields.groupBy("record_id").agg(F.min(F.struct("arrival", "service", "event", "failed", "latency_ms")).alias("r"))
    return first.select("record_id", "r.service", "r.arrival", F.coalesce("r.event", "r.arrival").alias("event"), "r.failed", "r.latency_ms")


def correction_triangle(
    records: DataFrame,
    keys: list[str],
    event: str = "event",
    arrival: str = "arrival",
    window_s: int = 300,
    cutoff_s: int = 3600,
    period_s: int = 120,
    measures: dict[str, str] | None = None,
) -> DataFrame:
    """Every revision of the count of every (keys, window): one row per arrival period that brought records.

    measures: further sums by name, each with its SQL expression over the records; null values add nothing.

    arrival_period 0 holds all that came before period_s had passed after the window's end, period n what
    came from n * period_s on. Columns: keys, window_start, window_end, arrival_period, new_records, records
    (the corrected count as of this revision), revision (1, 2, ...), is_final.
    """
    names, more = ", ".join(f"`{k}`" for k in keys), measures or {}
    taken = "".join(f", {x} AS `{m}`" for m, x in more.items())
    summed = "".join(f", coalesce(sum(`{m}`), 0) AS `{m}`" for m in more)
    revised = "".join(f", sum(`{m}`) OVER w AS `{m}`" for m in more)
    return records.sparkSession.sql(
        f"""
        WITH kept AS (
          SELECT {names}, `{arrival}` AS a, `{event}` - pmod(`{event}`, {window_s}) AS window_start{taken}
          FROM {{records}} WHERE `{arrival}` - `{event}` <= {cutoff_s}
        ), cells AS (
          SELECT {names}, window_start,
                 greatest(0, (a - window_start - {window_s}) div {period_s}) AS arrival_period,
                 count(*) AS new_records{summed}
          FROM kept GROUP BY ALL
        )
        SELECT {names}, window_start, window_start + {window_s} AS window_end, arrival_period, new_records,
               sum(new_records) OVER w AS records,
               row_number() OVER w AS revision,
               lead(arrival_period) OVER w IS NULL AS is_final{revised}
        FROM cells
        WINDOW w AS (PARTITION BY {names}, window_start ORDER BY arrival_period)
        """,
        records=records,
    )


def corrected_windows(triangle: DataFrame, keys: list[str]) -> DataFrame:
    """The windows that some revision corrects after their first publication."""
    return triangle.where(F.col("arrival_period") >= 1).select(*keys, "window_start").distinct()
