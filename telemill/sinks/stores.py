"""Sinks: object ids, insert-if-absent, fan-out, files and an injectable vector store.

Defined results: of several rows with one id the first by the given order is kept;
null template fields render as empty text; failures of the remote store are
counted, not raised.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an id template and their columns.
_FIELDS = {
    "Service": "service", "WindowStart": "window_start", "WindowEnd": "window_end", "Count": "count", "RPS": "rps", "ErrorRate": "error_rate",
    "P50": "p50", "P95": "p95", "P99": "p99", "AnomalyScore": "anomaly_score", "Locator": "locator", "SummaryText": "summary", "Summary": "summary",
}
DEFAULT_ID = "{{.Service}}:{{.WindowStart}}"
_SLOT = re.compile(r"\{\{\s*\.(\w+)(?:\.(\w+))?\s*\}\}")


def render_id(template: str = DEFAULT_ID) -> Column:
    """{{.Field}} and {{.Labels.key}} of a template as one string column."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        if m[1] == "Labels":
            parts.append(F.coalesce(F.col("labels")[m[2] or ""], F.lit("")))
        elif m[1] in _FIELDS:
            parts.append(F.coalesce(F.col(_FIELDS[m[1]]).cast("string"), F.lit("")))
        else:
            raise ValueError(f"unknown field {m[1]} in id template")
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def first_per_id(rows: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """The first row of each id; a hot id is reduced on the map side."""
    row = F.struct(*[c for c in rows.columns if c != id_col])
    return rows.groupBy(id_col).agg(F.min_by(row, F.struct(*order)).alias("r")).select(id_col, "r.*")


def insert_if_absent(rows: DataFrame, stored_ids: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """The rows to insert: the first of each id that isn't stored yet."""
    return first_per_id(rows.join(stored_ids.select(id_col), id_col, "left_anti"), id_col, order)


def fan_out(batch: DataFrame, writers: Sequence[Callable[[DataFrame], Any]]) -> None:
    """Every writer gets the same batch, computed once."""
    kept = batch.persist()
    try:
        for write in writers:
            write(kept)
    finally:
        kept.unpersist()


def parquet_writer(path: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame], None]:
    return lambda df: df.write.mode("append").partitionBy(*partition_by).parquet(path)


def parquet_inserter(path: str, template: str = DEFAULT_ID) -> Callable[[DataFrame], None]:
    """Appends the rows whose id isn't stored yet, so a repeated micro-batch inserts nothing twice.

    Ids lie beside the rows in column id; only that column is read back.
    """

    def write(df: DataFrame) -> None:
        rows = df.withColumn("id", render_id(template))
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        stored_ids = df.sparkSession.read.parquet(path).select("id") if there else None
        order = [c for c in ("window_start", "service", "count", "summary") if c in df.columns] or ["id"]
        new = first_per_id(rows, "id", order) if stored_ids is None else insert_if_absent(rows, stored_ids, "id", order)
        new.write.mode("append").parquet(path)

    return write


def noop_writer() -> Callable[[DataFrame], None]:
    return lambda df: df.write.format("noop").mode("overwrite").save()


def vector_objects(aggregates: DataFrame, class_name: str, template: str = DEFAULT_ID) -> DataFrame:
    """id, object: the JSON object of every aggregate row. JSON has no NaN: measures that aren't finite and vectors that hold such are left out."""
    finite = lambda f: F.when(F.abs(f.name) < float("inf"), F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
    props = F.struct(*[finite(f) for f in aggregates.schema.fields if f.name != "vector"])
    vector = F.when(F.forall("vector", lambda x: F.abs(x) < float("inf")), F.col("vector")) if "vector" in aggregates.columns else F.lit(None).cast("array<float>")
    return aggregates.select(render_id(template).alias("id"), F.to_json(F.struct(F.lit(class_name).alias("class"), render_id(template).alias("id"), vector.alias("vector"), props.alias("properties"))).alias("object"))


def push_objects(objects: DataFrame, post: Callable[[str], int]) -> DataFrame:
    """sent, existing, failed a partition: post(object) returns an HTTP status; 409 means the id exists and is fine."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = existing = failed = 0
        for pdf in parts:
            for body in pdf["object"]:
                try:
                    status = post(body)
                except Exception:  # noqa: BLE001 - a lost object is counted
                    status = 599
                sent, existing, failed = sent + (status < 300), existing + (status == 409), failed + (status >= 300 and status != 409)
        yield pd.DataFrame({"sent": [sent], "existing": [existing], "failed": [failed]})

    return objects.select("object").mapInPandas(run, "sent long, existing long, failed long")


def http_post(url: str, timeout_s: float = 10.0, api_key: str | None = None) -> Callable[[str], int]:
    """A post function for push_objects over HTTP."""

    def post(body: str) -> int:
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {}), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout_s) as r:
                return int(r.status)
        except urllib.error.HTTPError as e:
            return int(e.code)

    return post
