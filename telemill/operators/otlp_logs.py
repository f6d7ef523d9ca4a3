"""OTLP log records to flat JSON logs.

Records come as rows whose attribute bags are JSON objects in text (any-typed).
Defined results: zero and empty fields are left out; later fields overwrite
earlier ones of the same key; null bags are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.columns import fenced, non_blank, trimmed_number


def scalar_attributes(bag: Column) -> Column:
    """map<string,string> of the scalars of a JSON object; numbers as %.6f trimmed, complex values left out."""
    kinds = F.coalesce(F.from_json(bag, "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def text(k: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), trimmed_number(number))

    return F.map_filter(F.transform_values(kinds, text), lambda k, v: v.isNotNull())


def flatten(
    records: DataFrame, level_alias: str = "level", attribute_prefix: str = "", service_attribute: str = "service.name", resource_attrs: bool = True, scope_attrs: bool = True, resource_prefix: str = "resource.", scope_prefix: str = "scope."
) -> DataFrame:
    """records with fields map<string,string>: one flat JSON log each; the service comes with the resource's attributes."""
    records = records.withColumns({"__res": fenced(scalar_attributes(F.col("resource"))), "__attrs": fenced(scalar_attributes(F.col("attributes")))})
    res, attrs = F.col("__res"), F.col("__attrs")
    hexed = lambda c: F.lower(F.hex(F.when(F.length(c) > 0, c)))
    some = lambda c: F.when(c != 0, c.cast("string"))
    severity = non_blank(F.col("severity_text"))
    base = {
        "timestamp_unix_nano": some(F.col("time_unix_nano")), "observed_unix_nano": some(F.col("observed_unix_nano")), "severity_text": severity,
        level_alias: F.lower(severity), "severity_number": some(F.col("severity_number")), "body": F.col("body"), "trace_id": hexed(F.col("trace_id")),
        "span_id": hexed(F.col("span_id")), "flags": some(F.col("flags")),
    }
    pick = lambda d: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*d.values())), lambda k, v: v.isNotNull())
    maps = [pick(base), F.transform_keys(attrs, lambda k, v: F.concat(F.lit(attribute_prefix), k))]
    if resource_attrs:
        service = non_blank(res[service_attribute])
        maps += [F.transform_keys(res, lambda k, v: F.concat(F.lit(resource_prefix), k)), pick({"service": service, "service.name": service})]
    if scope_attrs:
        maps.append(pick({f"{scope_prefix}name": non_blank(F.col("scope_name")), f"{scope_prefix}version": non_blank(F.col("scope_version"))}))
    out = records.withColumns({f"__m{i}": fenced(m) for i, m in enumerate(maps)})
    fields = F.col("__m0")
    for i in range(1, len(maps)):
        fields = _overwritten(fields, F.col(f"__m{i}"))
    return out.withColumn("fields", fenced(fields)).drop("__res", "__attrs", *[f"__m{i}" for i in range(len(maps))])


def _overwritten(old: Column, new: Column) -> Column:
    """Both maps, of which the new one wins, whatever the session's map settings."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def to_envelopes(flat: DataFrame) -> DataFrame:
    """One json_logs envelope a record; rows that carry a passed body (otlp.decode_or_pass) keep it, its attrs and arrival."""
    attrs, arrival, body = F.create_map().cast("map<string,string>"), F.floor(F.col("time_unix_nano") / 1_000_000_000), F.to_json("fields").cast("binary")
    if "passed" in flat.columns:
        attrs, arrival, body = F.coalesce("attrs", attrs), F.when(F.col("passed").isNotNull() | (F.coalesce("time_unix_nano", F.lit(0)) == 0), F.col("ts_unix")).otherwise(arrival), F.coalesce("passed", body)
    return flat.select(F.lit("json_logs").alias("kind"), body.alias("bytes"), attrs.alias("attrs"), arrival.alias("ts_unix"))
