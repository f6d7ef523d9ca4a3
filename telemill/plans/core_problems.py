"""Queries of the general data problems (late events, grids, drifting schemas, spikes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import late_events, regular_grid, schema_drift, spikes
from telemill.session import all_rows, cut_lineage, table


def p3_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = late_events.json_log_records(table(spark, sf_dir, "envelopes"))
    made = late_events.correction_triangle(records, ["service"], measures={"errors": "failed", "latency_sum": "CAST(round(latency_ms * 1000) AS BIGINT)"})
    return made.withColumn("latency_sum", F.col("latency_sum") / 1000)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.corrected_windows(p3_revisions(spark, sf_dir), ["service"])


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid.regular_grid(table(spark, sf_dir, "aggregates"), "service", "window_start", "rps", "agg_id")
    return grid.withColumnRenamed("source", "service").withColumnRenamed("value", "rps")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_grid(spark, sf_dir).where(F.col("status") != regular_grid.OBSERVED).select("service", "slot_start")


def p4_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that have a reading: service, slot_start, rps."""
    return p4_grid(spark, sf_dir).where(F.col("status") == regular_grid.OBSERVED).select("service", "slot_start", "rps")


def p4_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, slots, observed, filled or marked, and cells whose value doesn't go with their mark."""
    grid, seen, filled, none = p4_grid(spark, sf_dir), F.col("status") == regular_grid.OBSERVED, F.col("status") == regular_grid.FILLED, F.col("status") == regular_grid.UNSUPPORTED
    wrong = ((seen | filled) & (F.col("rps").isNull() | F.isnan("rps"))) | (none & F.col("rps").isNotNull()) | (filled & (F.col("rps") < 0))
    return grid.groupBy("service").agg(F.count(F.lit(1)).alias("slots"), F.count_if(seen).alias("observed"), F.count_if(filled | none).alias("missing"), F.count_if(wrong).alias("wrong"))


def _p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(schema_drift.profiles(table(spark, sf_dir, "raw_logs")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5_changes(spark, sf_dir)


def p5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, file_no, change_kind, key: the report of p5_found with every rename as the key that goes and the one that comes."""
    c = _p5_changes(spark, sf_dir)
    renamed = F.col("change_kind") == "renamed"
    parts = F.when(renamed, F.array(F.struct(F.lit("removed").alias("change_kind"), F.col("field").alias("key")), F.struct(F.lit("added").alias("change_kind"), F.col("new_name").alias("key")))).otherwise(F.array(F.struct("change_kind", F.col("field").alias("key"))))
    return c.select("feed", "file_no", F.inline(parts))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_logs")
    fields = [(r["field"], r["field_type"]) for r in all_rows(table(spark, sf_dir, "log_fields"), 1000)]
    names = schema_drift.field_names(lines, _p5_changes(spark, sf_dir), [f for f, _ in fields])
    return schema_drift.unified_table(lines, cut_lineage(names), fields)


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    impossible = {"rps": F.col("rps") < 0, "error_rate": (F.col("error_rate") < 0) | (F.col("error_rate") > 1), "p99": (F.col("p99") < 0) | (F.col("p99") < F.col("p50"))}
    flags = spikes.flag_readings(table(spark, sf_dir, "aggregates"), "service", "window_start", impossible, "agg_id", carry=("p50",))
    return flags.withColumnRenamed("source", "service").withColumnRenamed("time", "window_start")


def p7_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_flags(spark, sf_dir).where("impossible").select("service", "window_start", "field")


def p7_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_flags(spark, sf_dir).where("stuck").select("service", "window_start", "field")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_flags(spark, sf_dir).select("service", "window_start", "field")


_RECORDS_SQL = """b AS (SELECT ts_unix, trim(decode(bytes)) AS t FROM envelopes WHERE kind = 'json_logs' AND bytes IS NOT NULL AND ts_unix IS NOT NULL),
j AS (SELECT ts_unix, try_cast(t AS JSON) AS j FROM b WHERE starts_with(t, '{')),
f AS (SELECT j->>'rid' AS rid, ts_unix AS arrival, coalesce(nullif(j->>'service', ''), 'unknown') AS service, j->>'ts' AS a, j->>'timestamp_unix_nano' AS n, (lower(j->>'level') IN ('error', 'fatal'))::INT AS failed, try_cast(j->>'latency_ms' AS DOUBLE) AS latency FROM j WHERE json_type(j) = 'OBJECT'),
e AS (SELECT rid, arrival, service, coalesce(failed, 0) AS failed, latency,
        coalesce(CASE WHEN try_cast(a AS BIGINT) IS NOT NULL THEN CASE WHEN a::BIGINT < 100000000000 THEN a::BIGINT WHEN a::BIGINT < 100000000000000 THEN a::BIGINT // 1000
                 WHEN a::BIGINT < 100000000000000000 THEN a::BIGINT // 1000000 ELSE a::BIGINT // 1000000000 END
                 WHEN regexp_matches(a, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]') THEN epoch_us(try_cast(a AS TIMESTAMPTZ)) // 1000000 END,
                 try_cast(n AS BIGINT) // 1000000000) AS event
      FROM f WHERE rid IS NOT NULL),
r AS (SELECT rid, service, arrival, coalesce(event, arrival) AS event, failed, latency FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY arrival, service, event NULLS FIRST) AS k FROM e) WHERE k = 1),
c AS (SELECT service, event - event % 300 AS window_start, greatest(0, (arrival - (event - event % 300) - 300) // 120) AS arrival_period, count(*) AS new_records, sum(failed) AS errors, coalesce(sum(round(latency * 1000)::BIGINT), 0) AS latency
      FROM r WHERE arrival - event <= 3600 GROUP BY ALL)"""

_READINGS_SQL = """a AS (SELECT *, row_number() OVER (PARTITION BY service, window_start, f ORDER BY agg_id) AS copy FROM (
  SELECT agg_id, service, window_start, f, v, p50 FROM (SELECT agg_id, service, window_start, p50, unnest(['rps', 'error_rate', 'p99']) AS f, unnest([rps, error_rate, p99]) AS v FROM aggregates WHERE service IS NOT NULL AND window_start IS NOT NULL) WHERE v IS NOT NULL AND NOT isnan(v))),
p AS (SELECT service, window_start, arg_min(p50, agg_id) AS p50 FROM aggregates WHERE p50 IS NOT NULL AND NOT isnan(p50) GROUP BY ALL),
m AS (SELECT a.service, a.window_start, f AS field, v, coalesce(isinf(v) OR v < 0 OR (f = 'error_rate' AND v > 1) OR (f = 'p99' AND v < p.p50), false) AS bad FROM a LEFT JOIN p USING (service, window_start) WHERE copy = 1)"""

#: p: the fields that belong to a file, with their type; n: the file before each file.
_FILES_SQL = """j AS (SELECT feed, file_no::BIGINT AS file_no, try_cast(trim(raw) AS JSON) AS j FROM raw_logs WHERE feed IS NOT NULL AND file_no IS NOT NULL AND starts_with(trim(raw), '{')),
o AS (SELECT feed, file_no, j, row_number() OVER () AS id FROM j WHERE json_type(j) = 'OBJECT'), t AS (SELECT feed, file_no, count(*) AS lines FROM o GROUP BY ALL), k AS (SELECT feed, file_no, id, j, unnest(list_distinct(json_keys(j))) AS key FROM o),
v AS (SELECT feed, file_no, key, CASE json_type(j, '$."' || key || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type FROM k),
h AS (SELECT feed, file_no, key, count(*) AS held FROM v GROUP BY ALL), y AS (SELECT feed, file_no, key, type, row_number() OVER (PARTITION BY feed, file_no, key ORDER BY count(*) DESC, type) AS place FROM v WHERE type IS NOT NULL GROUP BY feed, file_no, key, type),
p AS (SELECT h.feed, h.file_no, h.key, y.type FROM h JOIN t USING (feed, file_no) LEFT JOIN y ON y.feed = h.feed AND y.file_no = h.file_no AND y.key = h.key AND y.place = 1 WHERE h.held * 2 >= t.lines),
f AS (SELECT DISTINCT feed, file_no FROM p), n AS (SELECT * FROM (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS before FROM f) WHERE before IS NOT NULL)"""

ORACLE_SQL = {
    "p7_impossible": f"WITH {_READINGS_SQL} SELECT service, window_start, field FROM m WHERE bad",
    "p7_stuck": f"""WITH {_READINGS_SQL}, s AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w AS fresh FROM m WINDOW w AS (PARTITION BY service, field ORDER BY window_start)),
        g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY service, field ORDER BY window_start) AS run FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY service, field, run) AS len FROM g),
        c AS (SELECT service, field FROM m WHERE NOT bad GROUP BY ALL HAVING min(v) < max(v)) SELECT service, window_start, field FROM n JOIN c USING (service, field) WHERE len >= 10""",
    "p3_found": f"WITH {_RECORDS_SQL} SELECT DISTINCT service, window_start FROM c WHERE arrival_period >= 1",
    "p3_revisions": f"""WITH {_RECORDS_SQL} SELECT service, window_start, window_start + 300 AS window_end, arrival_period, new_records, sum(new_records) OVER w ::BIGINT AS records, row_number() OVER w AS revision,
        lead(arrival_period) OVER w IS NULL AS is_final, sum(errors) OVER w ::BIGINT AS errors, (sum(latency) OVER w ::BIGINT) / 1000 AS latency_sum FROM c WINDOW w AS (PARTITION BY service, window_start ORDER BY arrival_period)""",
    "p4_observed": """SELECT service, window_start - window_start % 60 AS slot_start, arg_min(rps, agg_id) AS rps FROM aggregates WHERE service IS NOT NULL AND window_start IS NOT NULL AND rps IS NOT NULL AND NOT isnan(rps) GROUP BY ALL""",
    "p4_marks": """WITH m AS (SELECT service, window_start - window_start % 60 AS slot, rps IS NOT NULL AND NOT isnan(rps) AS good FROM aggregates WHERE service IS NOT NULL AND window_start IS NOT NULL),
        x AS (SELECT service, slot // 86400 AS day, (max(slot) - min(slot)) // 60 + 1 AS n, count(DISTINCT slot) FILTER (good) AS seen FROM m GROUP BY ALL)
        SELECT service, sum(n)::BIGINT AS slots, sum(seen)::BIGINT AS observed, sum(n - seen)::BIGINT AS missing, 0::BIGINT AS wrong FROM x GROUP BY ALL""",
    "p5_keys": f"""WITH {_FILES_SQL}, c AS (SELECT p.feed, p.file_no, 'added' AS change_kind, p.key FROM p JOIN n ON n.feed = p.feed AND n.file_no = p.file_no ANTI JOIN p o ON o.feed = p.feed AND o.file_no = n.before AND o.key = p.key),
        r AS (SELECT n.feed, n.file_no, 'removed' AS change_kind, o.key FROM p o JOIN n ON n.feed = o.feed AND n.before = o.file_no ANTI JOIN p ON p.feed = n.feed AND p.file_no = n.file_no AND p.key = o.key)
        SELECT * FROM c UNION ALL SELECT * FROM r UNION ALL
        SELECT p.feed, p.file_no, 'retyped', p.key FROM p JOIN n ON n.feed = p.feed AND n.file_no = p.file_no JOIN p o ON o.feed = p.feed AND o.file_no = n.before AND o.key = p.key WHERE p.type <> o.type""",
    "p4_found": """WITH m AS (SELECT service, window_start - window_start % 60 AS slot, rps IS NOT NULL AND NOT isnan(rps) AS good FROM aggregates WHERE service IS NOT NULL AND window_start IS NOT NULL),
        x AS (SELECT service, slot // 86400 AS day, min(slot) AS lo, max(slot) AS hi FROM m GROUP BY ALL), s AS (SELECT service, unnest(range(lo, hi + 60, 60)) AS slot_start FROM x)
        SELECT service, slot_start FROM s ANTI JOIN (SELECT service, slot AS slot_start FROM m WHERE good) USING (service, slot_start)""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_revisions, p4_found, p4_grid, p4_observed, p4_marks, p5_found, p5_keys, p5_table, p7_found, p7_flags, p7_impossible, p7_stuck)}
