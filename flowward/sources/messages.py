"""Flow records as JSON messages: reading, decoding and the sender's address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowward.functions.casting import strip

INTERNAL_TOPIC = "network-traffic"
EXTERNAL_TOPIC = "external-traffic"
MESSAGE_SCHEMA = "value string, headers array<struct<key:string,value:binary>>, timestamp timestamp"
_MAP = "map<string,string>"


def read_flow_stream(spark: SparkSession, fmt: str = "kafka", **options: str) -> DataFrame:
    """The internal message stream: Kafka from the latest offset, or parquet files with the same columns.

    In the file form a file stands for a topic and a row's number in it for the offset.

    For Kafka pass at least ``kafka.bootstrap.servers`` through ``options``.
    """
    return _read(spark, fmt, {"subscribe": INTERNAL_TOPIC, "startingOffsets": "latest"}, options)


def read_external_stream(spark: SparkSession, fmt: str = "kafka", **options: str) -> DataFrame:
    """The external message stream; message headers are needed for the sender."""
    defaults = {"subscribe": EXTERNAL_TOPIC, "startingOffsets": "latest", "includeHeaders": "true"}
    return _read(spark, fmt, defaults, options)


def _read(spark: SparkSession, fmt: str, defaults: dict[str, str], options: dict[str, str]) -> DataFrame:
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**(defaults | options)).load()
    path = options.pop("path")
    files = reader.schema(MESSAGE_SCHEMA).options(**options).load(path)
    if fmt != "parquet":
        return files
    return files.select(
        "*",
        F.col("_metadata.file_path").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("_metadata.row_index").alias("offset"),
    )


def decode_messages(df: DataFrame) -> DataFrame:
    """Add ``text`` and ``payload`` (string map, null for bad JSON); blank messages are dropped.

    A key that a message repeats counts with its last value.
    """
    text = F.col("value").cast("string")
    kept = df.withColumn("text", text).where(F.col("text").isNotNull() & (F.length(strip(F.col("text"))) > 0))
    # Parsed in a step of its own: the step after uses the map several times.
    return kept.withColumn("payload", F.from_json("text", _MAP)).withColumn("payload", _last_wins(F.col("payload")))


def _last_wins(m: Column) -> Column:
    keys = F.map_keys(m)
    distinct = F.array_distinct(keys)
    values = F.transform(distinct, lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)["value"])
    return F.when(F.size(keys) == F.size(distinct), m).otherwise(F.map_from_arrays(distinct, values))


def sender_ip(df: DataFrame) -> Column:
    """The sender: the ``sender_ip`` header, else the payload's field, else null."""
    in_payload = F.col("payload")["sender_ip"]
    if "headers" not in df.columns:
        return in_payload
    header = F.get(F.filter("headers", lambda h: h["key"] == "sender_ip"), F.lit(0))["value"]
    return F.coalesce(F.try_validate_utf8(header.cast("string")), in_payload)


def unwrap(df: DataFrame) -> DataFrame:
    """Replace the payload by its ``features`` object where it has one; a value that is no object gives null."""
    m = F.col("payload")
    inner = F.from_json(m["features"], _MAP)
    chosen = df.withColumn("payload", F.when(F.map_contains_key(m, "features"), inner).otherwise(m))
    return chosen.withColumn("payload", _last_wins(F.col("payload")))
