"""Landing-zone records to envelopes: framing, size bounds, metadata, kinds, arrival, routing.

Network receivers belong to a gateway in front of Spark; it writes bodies to a
landing directory or a log broker, and these stages take over from there, in batch and in
streams alike. Defined results: null bodies are dropped; blank lines are dropped;
an unknown kind is metrics; null attributes are an empty map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of the kinds.
KIND_ALIASES = {
    "json_logs": ("json_logs", "logs", "json", "jsonlogs", "json-logs"),
    "prom_rw": ("prom_rw", "promrw", "promremotewrite", "prometheus_remote_write", "prometheusremotewrite"),
    "traces": ("traces", "trace"),
    "metrics": ("metrics", "metric"),
}
#: Headers that become attributes of remote-write envelopes. Credentials are never kept.
PROM_HEADERS = {"x-prometheus-remote-write-version": "promrw.version", "x-prometheus-scrape-timeout-seconds": "promrw.scrape_timeout_s", "x-scope-orgid": "org_id"}
SECRET_HEADERS = ("authorization", "cookie", "proxy-authorization")
_BLANKS = " \t\r\n\f\v"


def normal_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    out = F.when(k.isin(*KIND_ALIASES["json_logs"]), "json_logs")
    for name in ("prom_rw", "traces"):
        out = out.when(k.isin(*KIND_ALIASES[name]), name)
    return out.otherwise("metrics")


def split_lines(rows: DataFrame, body: str, max_line: int | None = None) -> DataFrame:
    """One row a non-blank line, trimmed, with line_no; lines above max_line bytes end their body."""
    lines = F.split(F.col(body), "\n")
    out = rows.select(*[c for c in rows.columns if c != body], F.posexplode(lines).alias("line_no", "line")).withColumn("line", F.trim("line", F.lit(_BLANKS)))
    if max_line is not None:
        kept = F.transform(lines, lambda x: F.octet_length(x) > max_line)
        stop = F.coalesce(F.array_position(kept, True), F.lit(0))
        bounded = rows.withColumn("__stop", stop)
        out = bounded.select(*[c for c in rows.columns if c != body], "__stop", F.posexplode(lines).alias("line_no", "line")).where((F.col("__stop") == 0) | (F.col("line_no") < F.col("__stop") - 1)).drop("__stop").withColumn("line", F.trim("line", F.lit(_BLANKS)))
    return out.where(F.col("line") != "")


def within_size(rows: DataFrame, body: str, max_bytes: int) -> DataFrame:
    return rows.where(F.octet_length(body) <= max_bytes)


def attributes(headers: Column, names: dict[str, str] | None = None) -> Column:
    """map<string,string> of headers (array of key, value); the last of a key wins, secrets are left out, names renames."""
    clean = F.filter(headers, lambda h: h["key"].isNotNull() & ~F.lower(h["key"]).isin(*SECRET_HEADERS))
    keys = F.array_distinct(F.transform(clean, lambda h: F.lower(h["key"]) if names else h["key"]))
    last = lambda k: F.element_at(F.filter(clean, lambda h: (F.lower(h["key"]) if names else h["key"]) == k), -1)["value"].cast("string")
    out = F.map_from_arrays(keys, F.transform(keys, last))
    if names:
        out = F.map_filter(F.transform_keys(F.map_filter(out, lambda k, v: k.isin(*names)), lambda k, v: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[k]), lambda k, v: v != "")
    return F.coalesce(out, F.create_map().cast("map<string,string>"))


def to_envelopes(rows: DataFrame, kind: Column, body: str = "bytes", attrs: Column | None = None, arrival: Column | None = None) -> DataFrame:
    """kind, bytes, attrs, ts_unix; the arrival defaults to now."""
    empty = F.create_map().cast("map<string,string>")
    return rows.where(F.col(body).isNotNull()).select(
        normal_kind(kind).alias("kind"), F.col(body).cast("binary").alias("bytes"), F.coalesce(attrs, empty).alias("attrs") if attrs is not None else empty.alias("attrs"),
        (arrival if arrival is not None else F.unix_timestamp(F.current_timestamp())).cast("long").alias("ts_unix"),
    )


def fan_in(*sources: DataFrame) -> DataFrame:
    """UNION ALL of sources by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def route(envelopes: DataFrame, *kinds: str) -> tuple[DataFrame, DataFrame]:
    """The rows of these kinds, and the rest, which passes through."""
    mine = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return envelopes.where(mine), envelopes.where(~mine)
