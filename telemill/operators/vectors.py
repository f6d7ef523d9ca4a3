"""Embedding vectors of aggregate rows: text by feature hashing, numbers by PCA, or a remote model.

Defined results: null texts give zero vectors; null measures count as 0 in
numeric features; a zero vector stays as it is; a PCA whose columns don't match
is not applied; empty labels are left out of texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.columns import fenced, fixed, non_blank

_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


def fnv1a64(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


def fnv1_64(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h * _PRIME) & _MASK) ^ b
    return h


#: What the components leave out or include unless told otherwise.
STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with")
LOG_FIELDS = ("org_id", "success", "error_code")
TRACE_ATTRIBUTES = ("http.method", "http.route", "status.code", "span.kind")


def _hashes(words: pa.Array, prefix: bytes, xor_first: bool) -> np.ndarray:
    """64-bit FNV-1a (xor_first) or FNV-1 of every word, byte position by byte position over all words at once."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1 + words.offset)[words.offset :]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    by_size = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][by_size], size[by_size]
    prime = np.uint64(_PRIME)
    first = np.uint64(fnv1a64(prefix) if xor_first else fnv1_64(prefix))
    h = np.full(len(words), first, np.uint64)
    for at in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -at, side="left"))  # words longer than at
        byte = data[start[:k] + at].astype(np.uint64)
        h[:k] = (h[:k] ^ byte) * prime if xor_first else (h[:k] * prime) ^ byte
    out = np.empty_like(h)
    out[by_size] = h
    return out


def tokens(text: Column, lowercase: bool = True) -> Column:
    """Runs of ASCII letters and digits, in lower case unless told otherwise."""
    given = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.lower(given), "[^a-z0-9]+") if lowercase else F.split(given, "[^a-zA-Z0-9]+"), "")


def ngrams(toks: Column, n: int, stopwords: Sequence[str] = ()) -> Column:
    """All 1..n-grams joined by _; a gram that holds a stopword is left out (neighbours are not closed up)."""
    kept = F.transform(toks, lambda t: F.when(~t.isin(*stopwords), t)) if stopwords else toks
    # Neighbours are zipped, not looked up by position: every gram costs the same however long the text is.
    grams, parts = kept, [kept]
    for k in range(2, max(1, min(n, 3)) + 1):
        later = F.slice(kept, k, F.greatest(F.size(kept) - (k - 1), F.lit(0)))
        grams = F.zip_with(F.slice(grams, 1, F.greatest(F.size(kept) - (k - 1), F.lit(0))), later, lambda a, b: F.concat(a, F.lit("_"), b))
        parts.append(grams)
    return F.array_compact(F.concat(*parts))


def hash_terms(terms: Column, dim: int = 384, unit: bool = False) -> Column:
    """array<int> of the signed term counts by hashed index; with unit, array<float> of length 1.

    The different terms of a batch are hashed once; counting is one weighted histogram.
    """

    @F.arrow_udf("array<float>" if unit else "array<int>")
    def embed(batch: pa.Array) -> pa.Array:
        lengths = np.asarray(batch.value_lengths().fill_null(0), np.int64)
        found = batch.flatten().cast(pa.large_string()).dictionary_encode()
        words = found.dictionary.cast(pa.large_binary())
        index = (_hashes(words, b"", True) % np.uint64(dim)).astype(np.int64)
        sign = 1 - 2 * (_hashes(words, b"sign:", False) & np.uint64(1)).astype(np.int64)
        codes = found.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros((len(batch), dim), np.float32 if unit else np.int32)
        step, ends = max(1, 4_000_000 // dim), np.r_[0, np.cumsum(lengths)]
        for lo in range(0, len(batch), step):
            hi = min(lo + step, len(batch))
            here = codes[ends[lo] : ends[hi]]
            row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            v = np.bincount(row * dim + index[here], weights=sign[here], minlength=(hi - lo) * dim).reshape(-1, dim)
            if unit:
                size = np.sqrt((v * v).sum(1, keepdims=True))
                v = v / np.where(size > 0, size, 1.0)
            counts[lo:hi] = v
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(counts.ravel()))

    return embed(terms)


def l2_normalise(v: Column) -> Column:
    """The vector over its length; zero vectors unchanged."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def hash_embedding(text: Column, dim: int = 384, n: int = 2, stopwords: Sequence[str] = (), lowercase: bool = True) -> Column:
    """Unit vector (array<float>) of the signed, hashed 1..n-grams of a text."""
    return hash_terms(ngrams(tokens(text, lowercase), n, stopwords), dim, unit=True)


def metric_features(p90_approx: bool = True) -> Column:
    """[p50, p90, p95, p99, rps, error_rate, error_rate * count, count per second of the window]; p90 between p50 and p95, or p95."""
    c = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("p50", "p95", "p99", "rps", "error_rate", "count")}
    p90 = (c["p50"] + c["p95"]) / 2 if p90_approx else c["p95"]
    return F.array(c["p50"], p90, c["p95"], c["p99"], c["rps"], c["error_rate"], c["error_rate"] * c["count"], F.try_divide(c["count"], 1 + F.col("window_end") - F.col("window_start")))


def load_pca(options: dict[str, Any]) -> dict | None:
    """rows, cols, data, center, scale from matrix_inline, else matrix_path; None unless the sizes are right.

    pca_inline and pca_path are other names of the two.
    """
    got, inline, path = None, options.get("matrix_inline") or options.get("pca_inline"), options.get("matrix_path") or options.get("pca_path")
    try:
        if inline:
            got = json.loads(inline) if isinstance(inline, str) else dict(inline)
        elif path and os.path.exists(path):
            with open(path) as f:
                got = json.load(f)
    except (ValueError, OSError):
        return None
    if not got or got.get("rows", 0) <= 0 or got.get("cols", 0) <= 1 or len(got.get("data") or []) != got["rows"] * got["cols"]:
        return None
    return {"center": options.get("center"), "scale": options.get("scale")} | {k: v for k, v in got.items() if v is not None}


def pca(features: Column, model: dict | None) -> Column:
    """Centred, scaled, projected and normalised features; only normalised without a model of as many columns."""
    if model is None or model["cols"] != 8:
        return l2_normalise(features)
    cols = model["cols"]
    x = features
    if model.get("center"):
        x = F.zip_with(x, F.lit([float(c) for c in model["center"]]), lambda a, b: a - b)
    if model.get("scale"):
        x = F.zip_with(x, F.lit([float(s) for s in model["scale"]]), lambda a, s: F.when(s > 1e-9, a / s).otherwise(a))
    rows = [F.lit([float(w) for w in model["data"][r * cols : (r + 1) * cols]]) for r in range(model["rows"])]
    return l2_normalise(F.array(*[F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for w in rows]))


def _window_parts() -> list[Column]:
    return [F.concat(F.lit("service="), "service"), F.concat(F.lit("ts_start="), F.col("window_start").cast("string")), F.concat(F.lit("ts_end="), F.col("window_end").cast("string"))]


def _labelled(key: str) -> Column:
    return F.concat(F.lit(f"{key}="), non_blank(F.col("labels")[key]))


def log_text(include: Sequence[str] = (), compat: bool = False) -> Column:
    """kind=log service=... ts_start=... ts_end=..., included labels in order, success, summary.

    success is the label where it is included and there, else whether no error was seen; compat repeats it behind the label.
    """
    derived = F.concat(F.lit("success="), F.when(F.col("error_rate") > 0, "false").otherwise("true"))
    parts = [F.coalesce(_labelled(k), derived) if k == "success" else _labelled(k) for k in sorted(include)]
    if "success" not in include:
        parts.append(derived)
    elif compat:
        parts.append(F.when(non_blank(F.col("labels")["success"]).isNotNull(), derived))
    return F.concat_ws(" ", F.lit("kind=log"), *_window_parts(), *parts, F.concat(F.lit("summary="), non_blank(F.col("summary"))))


def trace_text(include: Sequence[str] = TRACE_ATTRIBUTES, max_attrs: int = 6) -> Column:
    """kind=trace with window and measures, the first max_attrs of the included labels that are there, and the summary."""
    stats = [F.concat(F.lit(f"{c}="), fixed(F.coalesce(F.col(c), F.lit(0.0)), 6)) for c in ("p50", "p95", "p99", "rps", "error_rate")]
    there = F.slice(F.array_compact(F.array(*[_labelled(k) for k in include])), 1, max_attrs) if include else F.array().cast("array<string>")
    return F.concat_ws(" ", F.lit("kind=trace"), *_window_parts(), *stats, there, F.concat(F.lit("summary="), non_blank(F.col("summary"))))


def fallback_summary() -> Column:
    """Service, window in RFC 3339 UTC and measures."""
    utc = lambda c: F.concat(F.regexp_replace(F.date_format(F.timestamp_add("SECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"), " ", "T"), F.lit("Z"))
    stats = [F.concat(F.lit(f"{c}="), fixed(F.coalesce(F.col(c), F.lit(0.0)), 6)) for c in ("rps", "error_rate", "p50", "p95", "p99")]
    return F.concat_ws(" ", F.concat(F.lit("service="), "service"), F.concat(F.lit("window="), utc("window_start"), F.lit("/"), utc("window_end")), *stats, F.concat(F.lit("count="), F.col("count").cast("string")))


def vectorize(
    aggregates: DataFrame,
    dim: int = 384,
    n: int = 2,
    include: Sequence[str] = LOG_FIELDS,
    stopwords: Sequence[str] = (),
    pca_model: dict | None = None,
    ema_alpha: float = 0.0,
    slot=None,
    trace_attributes: Sequence[str] = TRACE_ATTRIBUTES,
    max_attrs: int = 6,
    p90_approx: bool = True,
    lowercase: bool = True,
    remote: Callable[[str], Sequence[float]] | None = None,
    retries: int = 2,
    allow_fallback: bool = True,
) -> DataFrame:
    """aggregates with vector, by labels.source: logs and traces as text, metrics as numbers, others by their summary.

    With remote, texts are embedded by that call; where it fails, by hashing if allow_fallback, else there is no vector.
    """
    source = F.coalesce(F.lower(F.col("labels")["source"]), F.lit(""))
    summary = F.when(F.trim(F.col("summary"), F.lit(" \t\r\n\f\v")) != "", F.col("summary"))
    text = F.when(source == "logs", log_text(include)).when(source == "traces", trace_text(trace_attributes, max_attrs)).when(source == "metrics", F.lit(None)).otherwise(F.coalesce(summary, fallback_summary()))
    numbers = metric_features(p90_approx)
    out = aggregates
    if 0 < ema_alpha <= 1:
        from telemill.operators.series import exponential_average

        names = [f"__x{i}" for i in range(8)]
        split = aggregates.withColumn("__f", numbers).withColumns({x: F.col("__f")[i] for i, x in enumerate(names)}).drop("__f")
        out = exponential_average(split, "service", ["window_start"], names, ema_alpha, slot=slot).drop(*names)
        numbers = F.array(*[F.col(f"ema_{x}") for x in names])
    numeric = pca(numbers, pca_model).cast("array<float>")
    out = out.withColumns({"__text": fenced(text), "__numeric": fenced(numeric)})
    if remote is not None:
        out = out.withColumn("__remote", F.when(F.col("__text").isNotNull(), remote_vector(F.col("__text"), remote, retries)))
        hashed = F.coalesce("__remote", F.when(F.col("__remote").isNull(), hash_embedding(F.col("__text"), dim, n, stopwords, lowercase))) if allow_fallback else F.col("__remote")
    else:
        hashed = hash_embedding(F.col("__text"), dim, n, stopwords, lowercase)
    made = out.withColumn("vector", F.when(source == "metrics", F.col("__numeric")).otherwise(hashed))
    return made.select(*[c for c in aggregates.columns if c != "vector"], "vector")


def _tried(call: Callable[[str], Sequence[float]], text: str, retries: int) -> np.ndarray | None:
    """The unit vector of a text, or None after retries + 1 failures; an empty answer is a failure."""
    for _ in range(retries + 1):
        try:
            got = np.asarray(call(text), dtype=np.float64)
        except Exception:  # noqa: BLE001 - any failure of the remote side counts as a failed try
            continue
        if got.size:
            size = np.linalg.norm(got)
            return (got / size if size > 0 else got).astype(np.float32)
    return None


def remote_vector(text: Column, call: Callable[[str], Sequence[float]], retries: int = 2) -> Column:
    """array<float> of an injected client; the different texts of a batch are sent once each."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        known = {t: _tried(call, t, retries) for t in batch.dropna().unique()}
        return pd.Series([None if t is None else known[t] for t in batch], dtype=object)

    return run.asNondeterministic()(text)


def http_embedding(endpoint: str, model: str, timeout_s: float = 5.0) -> Callable[[str], Sequence[float]]:
    """A call for remote_vector: POST {model, prompt} to <endpoint>/api/embeddings, which answers {embedding}."""
    url = endpoint.rstrip("/") + "/api/embeddings"

    def call(text: str) -> Sequence[float]:
        import urllib.request

        body = json.dumps({"model": model, "prompt": text}).encode()
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout_s) as r:
            return json.load(r)["embedding"]

    return call


def remote_embedding(rows: DataFrame, id_col: str, text_col: str, call: Callable[[str], Sequence[float]], retries: int = 2, fallback: Callable[[str], Sequence[float]] | None = None) -> DataFrame:
    """id, vector by an injected client, one session a partition; retries + 1 tries, then the fallback or null."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for text in pdf[text_col]:
                got = _tried(call, text or "", retries)
                if got is None and fallback is not None:
                    got = _tried(fallback, text or "", 0)
                out.append(got)
            yield pd.DataFrame({id_col: pdf[id_col], "vector": pd.Series(out, dtype=object)})

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, vector array<float>")
