"""Wire format of the public OTLP and remote-write messages, decoded without generated code.

MESSAGES names the fields that the engine reads; unknown fields are skipped. The
decoders run as mapInPandas over binary bodies and give typed rows. Bodies that
don't decode give no typed rows; decode_or_pass hands them on beside the typed
rows, from the same pass.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.frames import frame
from telemill.schema import LOG_RECORD, POINT, PROM_SAMPLE, SPAN

#: Message -> field number -> (name, type); a type in brackets repeats, a capitalised type is a message.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "AnyValue": {1: ("string", "string"), 2: ("bool", "bool"), 3: ("int", "int64"), 4: ("double", "double"), 5: ("array", "ArrayValue"), 6: ("kvlist", "KvList"), 7: ("bytes", "bytes")},
    "ArrayValue": {1: ("values", "[AnyValue]")},
    "KvList": {1: ("values", "[KeyValue]")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "Resource": {1: ("attributes", "[KeyValue]")},
    "Scope": {1: ("name", "string"), 2: ("version", "string")},
    "Traces": {1: ("resource_spans", "[ResourceSpans]")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scope_spans", "[ScopeSpans]")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "[Span]")},
    "Span": {5: ("name", "string"), 6: ("kind", "int64"), 7: ("start", "fixed64"), 8: ("end", "fixed64"), 9: ("attributes", "[KeyValue]"), 11: ("events", "[Event]"), 15: ("status", "Status")},
    "Event": {2: ("name", "string"), 3: ("attributes", "[KeyValue]")},
    "Status": {3: ("code", "int64")},
    "Metrics": {1: ("resource_metrics", "[ResourceMetrics]")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scope_metrics", "[ScopeMetrics]")},
    "ScopeMetrics": {2: ("metrics", "[Metric]")},
    "Metric": {1: ("name", "string"), 5: ("gauge", "Sum"), 7: ("sum", "Sum"), 9: ("histogram", "Histogram"), 10: ("exponential", "Sum"), 11: ("summary", "Sum")},
    "Sum": {1: ("points", "[NumberPoint]"), 2: ("temporality", "int64")},
    "NumberPoint": {3: ("time", "fixed64"), 4: ("as_double", "double"), 6: ("as_int", "sfixed64"), 7: ("attributes", "[KeyValue]")},
    "Histogram": {1: ("points", "[HistogramPoint]"), 2: ("temporality", "int64")},
    "HistogramPoint": {3: ("time", "fixed64"), 6: ("counts", "[fixed64]"), 7: ("bounds", "[double]"), 9: ("attributes", "[KeyValue]")},
    "Logs": {1: ("resource_logs", "[ResourceLogs]")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scope_logs", "[ScopeLogs]")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("records", "[LogRecord]")},
    "LogRecord": {1: ("time", "fixed64"), 2: ("severity_number", "int64"), 3: ("severity_text", "string"), 5: ("body", "AnyValue"), 6: ("attributes", "[KeyValue]"), 8: ("flags", "fixed32"), 9: ("trace_id", "bytes"), 10: ("span_id", "bytes"), 11: ("observed", "fixed64")},
    "WriteRequest": {1: ("timeseries", "[TimeSeries]")},
    "TimeSeries": {1: ("labels", "[Label]"), 2: ("samples", "[Sample]")},
    "Label": {1: ("name", "string"), 2: ("value", "string")},
    "Sample": {1: ("value", "double"), 2: ("timestamp", "int64")},
}
_FIXED = {"fixed64": "<Q", "sfixed64": "<q", "double": "<d", "fixed32": "<I"}


class WireError(ValueError):
    pass


#: What a body raises that is no message of its kind, or nests deeper than any sender means it to.
_UNREADABLE = (WireError, RecursionError)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def _scalar(kind: str, raw: Any) -> Any:
    if kind == "string":
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise WireError("text") from e
    if kind == "bytes":
        return bytes(raw)
    if kind == "bool":
        return bool(raw)
    return raw - (1 << 64) if raw >> 63 else raw


_MESSAGE, _PACKED, _VARINT = "message", "fixed", "varint"


def _plan(kind: str) -> tuple:
    """(many, kind, how to read it, struct of a fixed number or None)."""
    many, base = kind[0] == "[", kind.strip("[]")
    how = _MESSAGE if base[0].isupper() else _PACKED if base in _FIXED else base if base in ("string", "bytes") else _VARINT
    return many, base, how, struct.Struct(_FIXED[base]) if base in _FIXED else None


_PLANS = {message: {number: (name, *_plan(kind)) for number, (name, kind) in fields.items()} for message, fields in MESSAGES.items()}


def decode(message: str, data: bytes) -> dict[str, Any]:
    """The known fields of a message; WireError if the bytes aren't one."""
    plans, out, at, end = _PLANS[message], {}, 0, len(data)
    while at < end:
        key = data[at]
        if key < 0x80:
            at += 1
        else:
            key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if number == 0:
            raise WireError("field 0")
        if wire == 2:
            size = data[at] if at < end else 0x80
            if size < 0x80:
                at += 1
            else:
                size, at = _varint(data, at)
            raw = data[at : at + size]
            at += size
            if at > end:
                raise WireError("truncated")
        elif wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            raw = data[at : at + size]
            at += size
            if at > end:
                raise WireError("truncated")
        else:
            raise WireError("wire type")
        plan = plans.get(number)
        if plan is None:
            continue
        name, many, kind, how, fixed = plan
        if how is _MESSAGE:
            if wire != 2:
                raise WireError("message expected")
            value = decode(kind, raw)
        elif how is _PACKED:
            if wire == 0 or len(raw) % fixed.size or (wire == 2 and not many):
                raise WireError("fixed expected")
            values = [x for (x,) in fixed.iter_unpack(raw)]
            if many:
                out.setdefault(name, []).extend(values)
            elif values:
                out[name] = values[-1]
            continue
        elif wire != (0 if how is _VARINT else 2):
            raise WireError("type")
        else:
            value = _scalar(kind, raw)
        if many:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def encode(message: str, value: dict[str, Any]) -> bytes:
    """The inverse of decode, for tests and gateways."""
    out = bytearray()

    def number(n: int) -> None:
        n &= 0xFFFFFFFFFFFFFFFF
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)

    for field, (name, kind) in sorted(MESSAGES[message].items()):
        if value.get(name) is None:
            continue
        many, kind = kind[0] == "[", kind.strip("[]")
        items = value[name] if many else [value[name]]
        if many and kind in _FIXED:
            packed = b"".join(struct.pack(_FIXED[kind], x) for x in items)
            number(field << 3 | 2)
            number(len(packed))
            out += packed
            continue
        for x in items:
            if kind in _FIXED:
                number(field << 3 | (5 if kind == "fixed32" else 1))
                out += struct.pack(_FIXED[kind], x)
            elif kind in ("int64", "bool"):
                number(field << 3)
                number(int(x))
            else:
                raw = encode(kind, x) if kind[0].isupper() else x.encode() if kind == "string" else x
                number(field << 3 | 2)
                number(len(raw))
                out += raw
    return bytes(out)


def any_json(v: dict[str, Any] | None) -> Any:
    """AnyValue as a JSON value: ints become doubles, bytes lower hex, lists and maps nest, else null."""
    if not v:
        return None
    if "string" in v or "bool" in v or "double" in v:
        return next(v[k] for k in ("string", "bool", "double") if k in v)
    if "int" in v:
        return float(v["int"])
    if "array" in v:
        return [any_json(x) for x in v["array"].get("values", [])]
    if "kvlist" in v:
        return {x.get("key", ""): any_json(x.get("value")) for x in v["kvlist"].get("values", [])}
    return v["bytes"].hex() if "bytes" in v else None


def _strings(attributes: list[dict] | None) -> dict[str, str]:
    """Non-empty string attributes; the last of a key wins."""
    return {a.get("key", ""): a["value"]["string"] for a in attributes or () if a.get("value", {}).get("string")}


def _resource(x: dict) -> dict[str, str]:
    return {a.get("key", ""): a.get("value", {}).get("string", "") for a in x.get("resource", {}).get("attributes", [])}


def _span_rows(body: bytes) -> Iterator[tuple]:
    for r in decode("Traces", body).get("resource_spans", []):
        resource = _resource(r)
        for s in r.get("scope_spans", []):
            for x in s.get("spans", []):
                events = [{"name": e.get("name", ""), "attributes": _strings(e.get("attributes"))} for e in x.get("events", [])]
                yield resource, _strings(x.get("attributes")), x.get("kind", 0), x.get("status", {}).get("code", 0), x.get("start", 0), x.get("end", 0), events


def _point_rows(body: bytes) -> Iterator[tuple]:
    for r in decode("Metrics", body).get("resource_metrics", []):
        resource = _resource(r)
        for s in r.get("scope_metrics", []):
            for m in s.get("metrics", []):
                for kind in ("sum", "histogram"):
                    for p in m.get(kind, {}).get("points", []):
                        value = float(p["as_double"] if "as_double" in p else p.get("as_int", 0)) if kind == "sum" else None
                        yield resource, m.get("name", ""), kind, m[kind].get("temporality", 0), _strings(p.get("attributes")), value, p.get("bounds") if kind == "histogram" else None, p.get("counts") if kind == "histogram" else None, p.get("time", 0)
                if not any(k in m for k in ("sum", "histogram")):  # other types keep their service in the result
                    yield resource, m.get("name", ""), "other", 0, {}, None, None, None, next((p.get("time", 0) for k in ("gauge", "exponential", "summary") for p in m.get(k, {}).get("points", [])), 0)


def _log_rows(body: bytes) -> Iterator[tuple]:
    bag = lambda a: json.dumps({x.get("key", ""): any_json(x.get("value")) for x in a or ()})
    for r in decode("Logs", body).get("resource_logs", []):
        resource = bag(r.get("resource", {}).get("attributes"))
        for s in r.get("scope_logs", []):
            scope = s.get("scope", {})
            for x in s.get("records", []):
                text = any_json(x.get("body"))
                yield (resource, scope.get("name", ""), scope.get("version", ""), x.get("time", 0), x.get("observed", 0), x.get("severity_text", ""), x.get("severity_number", 0),
                       text if isinstance(text, str) or text is None else json.dumps(text), x.get("trace_id", b""), x.get("span_id", b""), x.get("flags", 0), bag(x.get("attributes")))


def _sample_rows(body: bytes) -> Iterator[tuple]:
    for t in decode("WriteRequest", body).get("timeseries", []):
        labels = {x.get("name", ""): x.get("value", "") for x in t.get("labels", [])}
        for s in t.get("samples", []):
            yield labels, s.get("value", 0.0), s.get("timestamp", 0)


_ROWS = {"traces": (_span_rows, SPAN), "metrics": (_point_rows, POINT), "logs": (_log_rows, LOG_RECORD), "prom_rw": (_sample_rows, PROM_SAMPLE)}


def _names(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip().split(" ")[0])
            start = i + 1
    return out


def decode_bodies(bodies: DataFrame, column: str, message: str) -> DataFrame:
    """Typed rows of traces, metrics, logs or prom_rw bodies; bodies that don't decode give none."""
    rows_of, schema = _ROWS[message]
    names = _names(schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for body in pdf[column]:
                if body is not None:
                    try:
                        rows.extend(list(rows_of(bytes(body))))
                    except _UNREADABLE:
                        continue
            cells = list(zip(*rows)) if rows else [()] * len(names)
            yield frame({n: list(c) if c else np.empty(0, dtype=object) for n, c in zip(names, cells)})

    return bodies.select(column).mapInPandas(run, schema)


def decode_or_pass(envelopes: DataFrame, message: str, keep: tuple[str, ...] = ("attrs", "ts_unix"), skip: Column | None = None) -> DataFrame:
    """Typed rows of envelopes with the columns keep and passed: null, or the body itself where it gives no rows.

    Every body is decoded once. Bodies for which skip holds are passed on without a look.
    """
    rows_of, schema = _ROWS[message]
    names = _names(schema)
    kept = ", ".join(f"{k} {envelopes.schema[k].dataType.simpleString()}" for k in keep)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for body, skipped, *rest in zip(pdf["bytes"], pdf["__skip"], *[pdf[k] for k in keep]):
                if body is None:
                    continue
                got: list[tuple] = []
                try:
                    got = [] if skipped else list(rows_of(bytes(body)))
                except _UNREADABLE:
                    pass
                rest = [None if isinstance(x, float) and x != x else x for x in rest]
                rows.extend((*r, *rest, None) for r in got)
                if not got:
                    rows.append((*[None] * len(names), *rest, bytes(body)))
            cells = list(zip(*rows)) if rows else [()] * (len(names) + len(keep) + 1)
            yield frame({n: list(c) if c else np.empty(0, dtype=object) for n, c in zip([*names, *keep, "passed"], cells)})

    given = envelopes.select("bytes", *keep, (F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)).alias("__skip"))
    return given.mapInPandas(run, f"{schema}, {kept}, passed binary")


def decodable(body: Column, message: str) -> Column:
    """Whether a body is a message of this kind."""
    rows_of = _ROWS[message][0]

    @F.pandas_udf("boolean")
    def run(b: pd.Series) -> pd.Series:
        def good(x: bytes | None) -> bool:
            try:
                return x is not None and sum(1 for _ in rows_of(bytes(x))) >= 0
            except _UNREADABLE:
                return False

        return pd.Series([good(x) for x in b])

    return run(body)
