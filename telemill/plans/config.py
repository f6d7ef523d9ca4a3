"""Pipeline configuration: YAML to dataclasses.

Components are keyed type/name. Pipelines may stand at the top level or under
service.pipelines; options may stand beside the type or under extra, nested ones
are read as logs.include_fields and so on. ${NAME} in a text is the environment
variable. An option that its component doesn't know is an error; unknown top-level
sections are accepted and ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: The options of every component type; other spellings follow their option.
_NETWORK = ("endpoint", "landing", "path", "kind", "max_files_per_trigger", "max_body_bytes", "read_timeout_ms", "write_timeout_ms", "idle_timeout_ms", "reflection", "max_recv_msg_bytes", "max_send_msg_bytes", "paths.*", "tls.*", "keepalive.*")
_BROKER = ("brokers", "endpoint", "topic", "group", "kind", "ndjson", "max_bytes", "max_offsets_per_trigger", "fail_on_data_loss", "landing", "max_files_per_trigger")
OPTIONS: dict[str, tuple[str, ...]] = {
    "landing": _NETWORK,
    "otlpgrpc": _NETWORK,
    "otlphttp": _NETWORK,
    "promrw": _NETWORK,
    "jsonlogs": (*_NETWORK, *_BROKER),
    "kafka": _BROKER,
    "pulsar": (*_BROKER, "subscription_type", "auth_token", "auth_token_file", "tls_trust_certs_file", "tls_allow_insecure", "receiver_queue_size", "message_chan_buffer"),
    "filter": ("stage", "on", "drop_non_matching", "expr"),
    "spanmetrics": ("dimensions", "histogram_buckets", "error_from_status", "error_from_events", "error_event_names", "error_event_attr_dims", "max_error_attr_values"),
    "otlplogs": ("resource_attrs", "scope_attrs", "attr_prefix", "resource_prefix", "scope_prefix", "level_alias", "service_key"),
    "summarizer": ("window_seconds", "service_attribute", "bucket_sample_cap", "quantiles"),
    "logsum": ("window_seconds", "service_field", "level_field", "error_levels", "user_id_fields", "topk_fields", "topk_limit", "quantile_field", "reservoir_cap", "quantiles"),
    "iforest": ("features", "threshold", "normalization", "baseline_window", "subsample_size", "model_path", "model", "model_inline", "n_trees"),
    "vectorizer": ("mode", "endpoint", "model", "timeout_ms", "retries", "allow_fallback", "hash_dim", "hash_ngrams", "lowercase", "stopwords", "logs.include_fields", "metrics.p90_approx", "metrics.ema_alpha",
                   "metrics.pca.enabled", "metrics.pca.matrix_inline", "metrics.pca.matrix_path", "metrics.pca.center", "metrics.pca.scale", "traces.include_span_attrs", "traces.max_attrs"),
    "parquet": ("path", "id_template", "insert_if_absent"),
    "noop": (),
    "vectordb": ("endpoint", "class", "id_template", "api_key", "timeout_seconds", "post"),
    "weaviate": ("endpoint", "class", "id_template", "api_key", "timeout_seconds", "post"),
}
_SPELLINGS: dict[str, dict[str, str]] = {
    "filter": {"expression": "expr"},
    "spanmetrics": {"status_errors": "error_from_status", "error_attributes": "error_event_attr_dims"},
    "otlplogs": {"attribute_prefix": "attr_prefix", "service_attribute": "service_key"},
    "logsum": {"top_fields": "topk_fields", "user_fields": "user_id_fields"},
    "iforest": {"subsample": "subsample_size"},
    "pulsar": {"url": "endpoint", "subscription": "group", "token": "auth_token"},
    "vectorizer": {"ngrams": "hash_ngrams", "include_fields": "logs.include_fields", "ema_alpha": "metrics.ema_alpha", "pca_inline": "metrics.pca.matrix_inline", "pca_path": "metrics.pca.matrix_path"},
}
_SECTIONS = ("logs", "metrics", "traces", "pca", "tls", "keepalive", "paths")


@dataclass(frozen=True)
class Component:
    type: str
    name: str
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.type}/{self.name}" if self.name else self.type

    def get(self, key: str, default: Any = None, kind: Callable[[Any], Any] | None = None) -> Any:
        """An option, converted; the default if it is missing or can't be converted."""
        value = self.options.get(key)
        if value is None:
            return default
        try:
            return value if kind is None else kind(value)
        except (TypeError, ValueError):
            return default


@dataclass(frozen=True)
class PipelineSpec:
    name: str
    receivers: tuple[str, ...]
    processors: tuple[str, ...]
    exporters: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    receivers: dict[str, Component]
    processors: dict[str, Component]
    exporters: dict[str, Component]
    pipelines: dict[str, PipelineSpec]


class ConfigError(ValueError):
    pass


def split_key(key: str) -> tuple[str, str]:
    kind, _, name = str(key).strip().partition("/")
    return kind.strip().lower(), name.strip()


def _flat(options: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Options of nested sections under dotted names."""
    out = {}
    for k, v in options.items():
        k = "on" if k is True else k  # YAML 1.1 reads the key on as a boolean
        if k in _SECTIONS and isinstance(v, dict):
            out |= _flat(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def _expanded(value: Any) -> Any:
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: _expanded(v) for k, v in value.items()}
    return [_expanded(v) for v in value] if isinstance(value, list) else value


def _known(key: str, kind: str, options: dict[str, Any]) -> dict[str, Any]:
    """Options under their own names; an error for those that the component doesn't have."""
    if kind not in OPTIONS:
        return options  # whoever builds it says that the type is unknown
    out, allowed = {}, OPTIONS[kind]
    for k, v in options.items():
        name = _SPELLINGS.get(kind, {}).get(k, k)
        if name not in (*allowed, "type") and not any(a.endswith(".*") and name.startswith(a[:-1]) for a in allowed):
            raise ConfigError(f"{key}: unknown option {k}")
        out[name] = v
    return out


def _components(section: Any) -> dict[str, Component]:
    out = {}
    for key, raw in (section or {}).items():
        options = dict(raw or {})
        options |= options.pop("extra", None) or {}
        kind, name = split_key(key)
        out[str(key)] = Component(kind, name, _known(str(key), kind, _expanded(_flat(options))))
    return out


def _pipelines(raw: dict[str, Any]) -> dict[str, PipelineSpec]:
    found = dict((raw.get("service") or {}).get("pipelines") or {}) | dict(raw.get("pipelines") or {})
    listed = lambda p, k: tuple(str(x) for x in (p or {}).get(k) or ())
    return {str(n): PipelineSpec(str(n), listed(p, "receivers"), listed(p, "processors"), listed(p, "exporters")) for n, p in found.items()}


def from_dict(raw: dict[str, Any]) -> Config:
    cfg = Config(_components(raw.get("receivers")), _components(raw.get("processors")), _components(raw.get("exporters")), _pipelines(raw))
    for p in cfg.pipelines.values():
        for part, known in (("receivers", cfg.receivers), ("processors", cfg.processors), ("exporters", cfg.exporters)):
            missing = [k for k in getattr(p, part) if k not in known]
            if missing:
                raise ConfigError(f"pipeline {p.name}: unknown {part} {', '.join(missing)}")
    return cfg


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})
