"""Log brokers and landing directories as sources, in batch and in streams.

Broker connectors are jars that a cluster brings along; here are the options and
the mapping to envelopes. Rate limits take the place of dropping under load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.schema import ENVELOPE
from telemill.sources.landing import attributes, split_lines, to_envelopes, within_size

KAFKA_MAX_BYTES = 10 * 1024 * 1024


def kafka_options(brokers: list[str], topic: str, group: str | None = None, max_bytes: int = KAFKA_MAX_BYTES, max_offsets: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source; offsets that are gone end the query unless fail_on_data_loss is off."""
    out = {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": topic, "includeHeaders": "true", "kafka.max.partition.fetch.bytes": str(max_bytes), "failOnDataLoss": str(fail_on_data_loss).lower()}
    if group:
        out["kafka.group.id"] = group
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


#: Spellings of the subscription types; any other is shared.
_SUBSCRIPTIONS = {"exclusive": "Exclusive", "shared": "Shared", "failover": "Failover", "key_shared": "Key_Shared", "keyshared": "Key_Shared", "key-shared": "Key_Shared"}


def pulsar_options(
    url: str, topic: str, subscription: str, kind: str = "shared", token: str | None = None, trust_certs: str | None = None, token_file: str | None = None, allow_insecure: bool = False, queue_size: int | None = None, fail_on_data_loss: bool = True
) -> dict[str, str]:
    """Options of the Pulsar source; a token goes before a token file."""
    if not (url.strip() and topic.strip() and subscription.strip()):
        raise ValueError("a service URL, a topic and a subscription are needed")
    out = {"service.url": url, "topic": topic, "predefinedSubscription": subscription, "subscriptionType": _SUBSCRIPTIONS.get(kind.strip().lower(), "Shared"), "failOnDataLoss": str(fail_on_data_loss).lower()}
    params = f"token:{token}" if token else f"file://{token_file}" if token_file else None
    if params:
        out |= {"pulsar.client.authPluginClassName": "org.apache.pulsar.client.impl.auth.AuthenticationToken", "pulsar.client.authParams": params}
    if trust_certs:
        out["pulsar.client.tlsTrustCertsFilePath"] = trust_certs
    if allow_insecure:
        out["pulsar.client.tlsAllowInsecureConnection"] = "true"
    if queue_size:
        out["pulsar.reader.receiverQueueSize"] = str(queue_size)
    return out


def read(spark: SparkSession, fmt: str, options: dict[str, str], streaming: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format(fmt)
    return reader.options(**options).load()


def broker_envelopes(messages: DataFrame, kind: Column, ndjson: bool = False, max_bytes: int = KAFKA_MAX_BYTES) -> DataFrame:
    """value, headers and timestamp of broker messages as envelopes; json_logs bodies optionally split into lines."""
    bounded = within_size(messages, "value", max_bytes)
    headers = attributes(F.col("headers")) if "headers" in messages.columns else F.create_map().cast("map<string,string>")
    kept = bounded.select(F.col("value").alias("bytes"), headers.alias("attrs"), F.unix_timestamp("timestamp").alias("ts_unix"))
    if ndjson:
        lines = split_lines(kept.withColumn("text", F.col("bytes").cast("string")).drop("bytes"), "text", max_bytes)
        kept = lines.select(F.col("line").cast("binary").alias("bytes"), "attrs", "ts_unix")
    return to_envelopes(kept, kind, "bytes", F.col("attrs"), F.col("ts_unix"))


def landing_lines(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """JSON lines of a directory as json_logs envelopes; the arrival is the file's time."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.text(path).select(F.trim("value").alias("line"), F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("at")).where("line <> ''")
    return to_envelopes(text, F.lit("json_logs"), "line", None, F.col("at"))


def landing_envelopes(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Envelopes that a gateway wrote as Parquet; bodies above max_bytes are left out, as its receiver would."""
    reader = (spark.readStream if streaming else spark.read).schema(ENVELOPE)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows if max_bytes is None else within_size(rows, "bytes", max_bytes)
