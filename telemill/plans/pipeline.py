"""Pipelines composed from configuration; every stage is a pure DataFrame transformation.

A Flow carries envelopes, typed metric points and aggregate rows side by side;
each processor takes the rows it knows and passes the others on. One definition
serves batch DataFrames and the micro-batches of a stream; on a stream rows of open
windows and totals by series and key are held over to the next micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.filters.expressions import filter_aggregates, filter_envelopes
from telemill.functions.columns import fenced
from telemill.operators import forest, late_events, logs, metrics, otlp_logs, spans, vectors
from telemill.plans.config import Component, Config, ConfigError
from telemill.schema import ENVELOPE, KINDS
from telemill.sinks import stores
from telemill.sources import brokers, landing, otlp
from telemill.streaming.held import Held, Slot


@dataclass(frozen=True)
class Flow:
    """Envelopes by kind, so that a stage reads and decodes only its own; metric points; aggregate rows."""

    kinds: dict[str, DataFrame]
    points: DataFrame | None = None
    aggregates: DataFrame | None = None
    held: Held | None = None

    @staticmethod
    def of(envelopes: DataFrame, held: Held | None = None) -> Flow:
        return Flow({k: envelopes.where(F.col("kind") == k) for k in KINDS}, held=held)

    def closed(self, name: str, rows: DataFrame, seconds: Column, window: int) -> DataFrame:
        """The rows of whole windows: in batches all of them, on streams those of the windows that close now."""
        return rows if self.held is None else self.held.closed(name, rows, seconds, window)

    def slot(self, name: str) -> Slot | None:
        return None if self.held is None else Slot(self.held, name)

    def with_kind(self, kind: str, rows: DataFrame | None) -> Flow:
        return replace(self, kinds={k: v for k, v in (self.kinds | {kind: rows}).items() if v is not None})

    def with_points(self, points: DataFrame) -> Flow:
        return replace(self, points=points if self.points is None else self.points.unionByName(points))

    def with_aggregates(self, rows: DataFrame) -> Flow:
        return replace(self, aggregates=rows if self.aggregates is None else self.aggregates.unionByName(rows))


Stage = Callable[[Flow], Flow]


def _filter(c: Component) -> Stage:
    expression, on, drop = c.get("expr", "", str), c.get("on", "metrics", str).strip().lower(), c.get("drop_non_matching", True, bool)
    post = c.get("stage", "pre", str).strip().lower() == "post"

    def run(flow: Flow) -> Flow:
        out = flow
        if (post or on == "aggregates") and flow.aggregates is not None:
            out = replace(out, aggregates=filter_aggregates(flow.aggregates, expression, drop))
        if not post:
            out = replace(out, kinds={k: filter_envelopes(v, expression, on, drop) for k, v in flow.kinds.items()})
        return out

    return run


def _names(c: Component, key: str, default: Sequence[str]) -> list[str]:
    """A list of non-empty texts."""
    given = c.get(key)
    return [str(x) for x in (default if not isinstance(given, (list, tuple)) else given) if x not in (None, "")]


def _spanmetrics(c: Component) -> Stage:
    dimensions, bounds = _names(c, "dimensions", ()), tuple(float(b) for b in c.get("histogram_buckets", spans.DURATION_BOUNDS))
    events = _names(c, "error_event_names", ("exception",)) if c.get("error_from_events", True, bool) else []

    def run(flow: Flow) -> Flow:
        if "traces" not in flow.kinds:
            return flow
        rows = otlp.decode_or_pass(flow.kinds["traces"], "traces")
        points = spans.to_points(rows.where("passed IS NULL"), dimensions, bounds, events, _names(c, "error_event_attr_dims", ()), c.get("error_from_status", True, bool))
        # Bodies without a span go on as they came.
        rest = rows.where("passed IS NOT NULL").select(F.lit("traces").alias("kind"), F.col("passed").alias("bytes"), "attrs", "ts_unix")
        return flow.with_kind("traces", rest).with_points(points)

    return run


def _otlplogs(c: Component) -> Stage:
    def run(flow: Flow) -> Flow:
        if "json_logs" not in flow.kinds:
            return flow
        is_json = F.trim(F.col("bytes").cast("string")).startswith("{")
        records = otlp.decode_or_pass(flow.kinds["json_logs"], "logs", skip=is_json)
        flat = otlp_logs.flatten(
            records, c.get("level_alias", "level", str) or "level", c.get("attr_prefix", "", str), c.get("service_key", "service.name", str) or "service.name",
            c.get("resource_attrs", True, bool), c.get("scope_attrs", True, bool), c.get("resource_prefix", "", str) or "resource.", c.get("scope_prefix", "", str) or "scope.",
        )
        return flow.with_kind("json_logs", otlp_logs.to_envelopes(flat))

    return run


def _seconds(c: Component) -> int:
    return int(c.get("window_seconds", 60, float)) if c.get("window_seconds", 60, float) >= 1 else 60


def _summarizer(c: Component) -> Stage:
    def run(flow: Flow) -> Flow:
        cap, window = c.get("bucket_sample_cap", 50, int), _seconds(c)
        attribute = c.get("service_attribute", "service.name", str)
        out, nanos = flow, F.col("time_unix_nano") / 1_000_000_000
        if flow.points is not None:
            out = out.with_aggregates(metrics.summarize_points(flow.closed(f"{c.key}:traces", flow.points, nanos, window), window, cap, attribute, "traces"))
        if "metrics" in flow.kinds:
            decoded = otlp.decode_bodies(flow.kinds["metrics"], "bytes", "metrics")
            whole = flow.closed(f"{c.key}:metrics", decoded, nanos, window)
            out = out.with_aggregates(metrics.summarize_points(metrics.to_delta(whole, flow.slot(f"{c.key}:series")), window, cap, attribute, "metrics"))
        if "prom_rw" in flow.kinds:
            samples = otlp.decode_bodies(flow.kinds["prom_rw"], "bytes", "prom_rw")
            out = out.with_aggregates(metrics.summarize_prometheus(flow.closed(f"{c.key}:prom_rw", samples, F.col("ts_ms") / 1000, window), window, cap, attribute))
        return replace(out, points=None).with_kind("metrics", None).with_kind("prom_rw", None)

    return run


def _logsum(c: Component) -> Stage:
    fields, users = _names(c, "topk_fields", ()), _names(c, "user_id_fields", logs.USER_KEYS)
    levels = _names(c, "error_levels", logs.ERROR_LEVELS)

    def run(flow: Flow) -> Flow:
        if "json_logs" not in flow.kinds:
            return flow
        mine = flow.kinds["json_logs"]
        v = F.col("v")
        get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
        nanos = F.floor(get("timestamp_unix_nano").try_cast("decimal(38,0)") / 1_000_000_000).cast("long")
        at = F.coalesce(F.when(nanos > 0, nanos), late_events.readable_seconds(get("ts")), F.col("ts_unix"))
        read = {
            "ts": at, "service": logs.service_of(v, c.get("service_field", "service", str)), "level": logs.first_field(v, [c.get("level_field", "level", str)]),
            "user": logs.first_field(v, users) if users else F.lit(None).cast("string"), "latency_ms": logs.numeric_field(v, c.get("quantile_field", "latency_ms", str)),
            **{f"field_{i}": logs.first_field(v, [f]) for i, f in enumerate(fields)},
        }
        parsed = mine.select("ts_unix", fenced(logs.parse_object(F.col("bytes").cast("string"))).alias("v")).where("v IS NOT NULL")
        typed = parsed.select(*[fenced(x).alias(k) for k, x in read.items()])
        whole = flow.closed(c.key, typed, F.col("ts"), _seconds(c))
        made = logs.summarize(whole, _seconds(c), {f: f"field_{i}" for i, f in enumerate(fields)}, limit=c.get("topk_limit", 5, int), levels=levels)
        return flow.with_kind("json_logs", None).with_aggregates(made)

    return run


def _iforest(c: Component) -> Stage:
    trees, threshold = forest.load_model(c.options), c.get("threshold", None, float)

    def run(flow: Flow) -> Flow:
        if flow.aggregates is None:
            return flow
        scored = forest.with_score(flow.aggregates, trees, tuple(_names(c, "features", forest.FEATURES)), c.get("normalization", "none", str).strip().lower(), c.get("subsample_size", 256, int), threshold, flow.slot(c.key))
        return replace(flow, aggregates=scored)

    return run


def _vectorizer(c: Component) -> Stage:
    pca = {k: c.get(f"metrics.pca.{k}") for k in ("matrix_inline", "matrix_path", "center", "scale")}
    wanted = c.get("metrics.pca.enabled", bool(pca["matrix_inline"] or pca["matrix_path"]), bool)
    model = vectors.load_pca(pca) if wanted else None
    mode = c.get("mode", "remote" if c.get("endpoint") else "hash", str).strip().lower()
    remote = None if mode == "hash" else c.options.get("call") or vectors.http_embedding(c.get("endpoint", "http://localhost:11434", str), c.get("model", "nomic-embed-text", str), c.get("timeout_ms", 5000, float) / 1000)
    # Modes of no known name try the remote side and always fall back.
    fallback = c.get("allow_fallback", True, bool) or mode not in ("ollama", "remote")
    lower, grams = c.get("lowercase", True, bool), c.get("hash_ngrams", 2, int)
    stop = [w.lower() if lower else w for w in _names(c, "stopwords", vectors.STOPWORDS)]

    def run(flow: Flow) -> Flow:
        if flow.aggregates is None:
            return flow
        made = vectors.vectorize(
            flow.aggregates, max(1, c.get("hash_dim", 384, int)), grams if 1 <= grams <= 3 else 2, _names(c, "logs.include_fields", vectors.LOG_FIELDS), stop, model, c.get("metrics.ema_alpha", 0.0, float), flow.slot(c.key),
            _names(c, "traces.include_span_attrs", ()) or vectors.TRACE_ATTRIBUTES, max(1, c.get("traces.max_attrs", 6, int)), c.get("metrics.p90_approx", True, bool), lower, remote, max(0, c.get("retries", 2, int)), fallback,
        )
        return replace(flow, aggregates=made)

    return run


PROCESSORS: dict[str, Callable[[Component], Stage]] = {"filter": _filter, "spanmetrics": _spanmetrics, "otlplogs": _otlplogs, "summarizer": _summarizer, "logsum": _logsum, "iforest": _iforest, "vectorizer": _vectorizer}


_GATEWAYS = {"landing": "metrics", "otlpgrpc": "metrics", "otlphttp": "metrics", "promrw": "prom_rw", "jsonlogs": "json_logs"}


def _receive(spark: SparkSession, c: Component, streaming: bool, landing_root: str | None) -> DataFrame:
    """The envelopes of a receiver.

    Network receivers are a gateway's: it writes to the folder named by landing (or path, where no endpoint makes that the
    path of a URL), else to <landing_root>/<type>_<name>. A broker's topic can be landed likewise.
    """
    kind, limit = F.lit(c.get("kind", _GATEWAYS.get(c.type, "metrics"), str)), c.get("max_files_per_trigger", None, int)
    folder = c.get("landing") or (c.get("path") if not c.get("endpoint") else None)
    at_broker = c.type in ("kafka", "pulsar") or (c.type == "jsonlogs" and c.get("topic"))
    if folder is None and landing_root is not None:
        folder = f"{landing_root.rstrip('/')}/{c.key.replace('/', '_')}"
    if folder is not None and c.type == "jsonlogs":
        return brokers.landing_lines(spark, folder, streaming, limit)
    if folder is not None:
        rows = brokers.landing_envelopes(spark, folder, streaming, limit, c.get("max_body_bytes", None, int) or c.get("max_recv_msg_bytes", None, int))
        return rows.withColumn("kind", landing.normal_kind(kind)) if at_broker else rows
    if c.type == "pulsar":
        options = brokers.pulsar_options(
            c.get("endpoint", "", str) or str((c.get("brokers") or [""])[0]), c.get("topic", "", str), c.get("group", "", str), c.get("subscription_type", "shared", str), c.get("auth_token", None, str),
            c.get("tls_trust_certs_file", None, str), c.get("auth_token_file", None, str), c.get("tls_allow_insecure", False, bool), c.get("receiver_queue_size", 1000, int), c.get("fail_on_data_loss", True, bool),
        )
        return brokers.broker_envelopes(brokers.read(spark, "pulsar", options, streaming), kind, c.get("ndjson", False, bool))
    if at_broker:
        options = brokers.kafka_options(list(c.get("brokers", [])), c.get("topic", "", str), c.get("group", None, str), c.get("max_bytes", brokers.KAFKA_MAX_BYTES, int), c.get("max_offsets_per_trigger", None, int), c.get("fail_on_data_loss", True, bool))
        return brokers.broker_envelopes(brokers.read(spark, "kafka", options, streaming), kind, c.get("ndjson", c.type == "jsonlogs", bool))
    raise ConfigError(f"{c.key}: no landing folder" if c.type in _GATEWAYS else f"unknown receiver type {c.type}")


def _exporter(c: Component) -> Callable[[DataFrame], object]:
    if c.type == "parquet":
        if c.get("insert_if_absent", False, bool):
            return stores.parquet_inserter(c.options["path"], c.get("id_template", stores.DEFAULT_ID, str))
        return stores.parquet_writer(c.options["path"])
    if c.type == "noop":
        return stores.noop_writer()
    if c.type in ("vectordb", "weaviate"):
        post = c.options.get("post") or stores.http_post(str(c.options["endpoint"]).rstrip("/") + "/v1/objects", c.get("timeout_seconds", 10.0, float), c.get("api_key", None, str))
        template, name = c.get("id_template", "{{.Service}}:{{.WindowStart}}:{{.Labels.source}}", str), c.get("class", "Aggregate", str)
        return lambda df: stores.push_objects(stores.vector_objects(df, name, template), post).agg(*[F.sum(x).alias(x) for x in ("sent", "existing", "failed")]).collect()
    raise ConfigError(f"unknown exporter type {c.type}")


@dataclass(frozen=True)
class Pipeline:
    name: str
    receivers: tuple[Component, ...]
    stages: tuple[Stage, ...]
    writers: tuple[Callable[[DataFrame], object], ...]
    landing_root: str | None = None

    def aggregates(self, envelopes: DataFrame, held: Held | None = None) -> DataFrame | None:
        """The aggregate rows of a batch of envelopes; rows that never became aggregates are left out."""
        return reduce(lambda flow, stage: stage(flow), self.stages, Flow.of(envelopes, held)).aggregates

    def source(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        return landing.fan_in(*[_receive(spark, c, streaming, self.landing_root) for c in self.receivers])

    def run_batch(self, envelopes: DataFrame, held: Held | None = None) -> None:
        rows = self.aggregates(envelopes, held)
        if rows is not None:
            stores.fan_out(rows, self.writers or (stores.noop_writer(),))
        if held is not None:
            held.commit()

    def close_windows(self, spark: SparkSession, checkpoint: str) -> None:
        """Writes the windows that a stopped stream has left open; rows of theirs that come afterwards are late."""
        held = Held(spark, checkpoint, None, 0.0, last=True)
        if held.before is not None:
            self.run_batch(spark.createDataFrame([], ENVELOPE), held)

    def run_stream(self, spark: SparkSession, checkpoint: str, trigger: dict | None = None, lateness_seconds: float = 600.0, name: str | None = None) -> StreamRun:
        """The pipeline over its receivers as a streaming query.

        A window is written once, whole, when the newest time of its input has passed its end by lateness_seconds; later
        rows of it are counted as late. Without a trigger the input ends with what is there now, and awaitTermination
        closes all windows; with one, windows still open stay held for the next run on the same checkpoint.
        """
        stream = self.source(spark, streaming=True)
        batch = lambda df, n: self.run_batch(df, Held(df.sparkSession, checkpoint, n, lateness_seconds))
        query = stream.writeStream.queryName(name or self.name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start()
        return StreamRun(query, None if trigger else lambda: self.close_windows(spark, checkpoint))


class StreamRun:
    """A streaming query that closes the open windows once its input has ended."""

    def __init__(self, query: StreamingQuery, at_end: Callable[[], None] | None):
        self.query, self._at_end = query, at_end

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def stop(self) -> None:
        self._at_end = None
        self.query.stop()

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802 - as in StreamingQuery
        ended = self.query.awaitTermination(timeout)
        if ended is not False and self._at_end is not None:
            at_end, self._at_end = self._at_end, None
            at_end()
        return ended


def build(cfg: Config, landing_root: str | None = None) -> dict[str, Pipeline]:
    """All pipelines; every configured component is instantiated, so unknown types fail early."""
    stages, writers = {}, {}
    for key, c in cfg.receivers.items():
        if c.type not in _GATEWAYS and c.type not in ("kafka", "pulsar"):
            raise ConfigError(f"unknown receiver type {c.type}")
    for key, c in cfg.processors.items():
        if c.type not in PROCESSORS:
            raise ConfigError(f"unknown processor type {c.type}")
        stages[key] = PROCESSORS[c.type](c)
    for key, c in cfg.exporters.items():
        writers[key] = _exporter(c)
    return {
        name: Pipeline(name, tuple(cfg.receivers[r] for r in p.receivers), tuple(stages[s] for s in p.processors), tuple(writers[w] for w in p.exporters), landing_root)
        for name, p in cfg.pipelines.items()
    }
