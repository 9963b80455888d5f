"""Structured Streaming jobs run over the test tables until all input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.features import pack_features
from flowward.operators.scoring import rule_threat_score
from flowward.plans.catalog.frames import live_messages
from flowward.plans.catalog.registry import query
from flowward.profiles import ATTACK_PROFILE, THREAT_LEGACY, default_sources
from flowward.session import scratch_path
from flowward.sources import flow_views as V
from flowward.sources.messages import read_external_stream, read_flow_stream
from flowward.sources.tables import load_table, load_tables, write_dim
from flowward.streaming import live
from flowward.streaming.scoring import file_message_sink, score_batch, score_external_stream, score_stream

ALL = {"availableNow": True}


PARTS = 3


def _in_files(df: DataFrame, key: F.Column, name: str) -> tuple[str, int]:
    """``df`` in ``PARTS`` parts, written one after the other by all tasks, and the files of a part: a micro-batch each."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    files, most = 0, 1
    for part in range(PARTS):
        df.where(F.pmod(F.xxhash64(key), F.lit(PARTS)) == part).write.mode("append").parquet(path)
        now = len(spark.read.schema(df.schema).parquet(path).inputFiles())
        files, most = now, max(most, now - files)
    return path, most


def message_stream(messages: DataFrame, external: bool = False) -> DataFrame:
    """Messages through the reader of the internal or the external stream, part by part."""
    spark = messages.sparkSession
    if "headers" not in messages.columns:
        messages = messages.withColumn("headers", F.array().cast("array<struct<key:string,value:binary>>"))
    path, files = _in_files(messages.select("value", "headers", "timestamp"), F.col("value"), "messages")
    read = read_external_stream if external else read_flow_stream
    return read(spark, "parquet", path=path, maxFilesPerTrigger=str(files))


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored events as a stream of several files, not in order of time."""
    events = V.read_table(spark, sf_dir, "events")
    path, files = _in_files(events, F.col("event_id"), "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return rule_threat_score(V.as_view(stream, V.FLOW10))


def threat_messages(events: DataFrame) -> DataFrame:
    """Events as flat JSON flow messages in the columns a message source has; error events are broken JSON."""
    flows = pack_features(V.as_view(events, V.FLOW10 | {"kind": "event_type"}), THREAT_LEGACY)
    body = F.when(F.col("kind") == "error", F.lit("not json")).otherwise(F.to_json("features"))
    return flows.select(body.alias("value"), F.col("created_at").alias("timestamp"))


def attack_messages(orders: DataFrame) -> DataFrame:
    """Orders as flat JSON attack-profile messages."""
    flows = pack_features(V.as_view(orders, V.FLOW42), ATTACK_PROFILE)
    return flows.select(F.to_json("features").alias("value"), F.col("created_at").alias("timestamp"))


def external_messages(events: DataFrame) -> DataFrame:
    """Events as enveloped messages; purchases carry the sender in a header, views carry none at all."""
    flows = pack_features(V.as_view(events, V.FLOW10 | {"kind": "event_type", "sender": V.MESSAGES["sender_ip"]}), THREAT_LEGACY)
    kind, sender = F.col("kind"), F.col("sender")
    header = F.array(F.struct(F.lit("sender_ip").alias("key"), sender.cast("binary").alias("value")))
    none = F.array().cast("array<struct<key:string,value:binary>>")
    in_payload = F.when(kind == "purchase", F.lit("0.0.0.0")).when(kind != "view", sender)
    return flows.select(
        F.to_json(F.struct(in_payload.alias("sender_ip"), F.col("features"))).alias("value"),
        F.when(kind == "purchase", header).otherwise(none).alias("headers"),
        F.col("created_at").alias("timestamp"),
    )


@query(
    """SELECT t.created_at, t.prediction_score, t.is_attack, 'realtime' AS source FROM threat t
    JOIN events e ON e.event_id = t.id WHERE e.event_type <> 'error'"""
)
def stream_scored_threats(spark, sf_dir):
    """The internal stream into the result tables; threat predictions read back."""
    root = scratch_path(spark, "stream")
    messages = message_stream(threat_messages(V.read_table(spark, sf_dir, "events")))
    score_stream(messages, root, f"{root}/checkpoint", **ALL).awaitTermination()
    stored = load_table(spark, "threat_predictions", root)
    return stored.select("created_at", "prediction_score", "is_attack", "source")


@query("SELECT CAST(ts AS TIMESTAMP) AS created_at, 'not a JSON object' AS reason FROM events WHERE event_type = 'error'")
def stream_quarantine(spark, sf_dir):
    """Messages of the internal stream that could not be scored."""
    root = scratch_path(spark, "stream")
    messages = message_stream(threat_messages(V.read_table(spark, sf_dir, "events")))
    score_stream(messages, root, f"{root}/checkpoint", **ALL).awaitTermination()
    return spark.read.parquet(f"{root}/quarantine").select("created_at", "reason")


@query(
    """SELECT a.created_at, a.attack_type_name, a.confidence, x.action_type, 'realtime' AS source FROM attack a
    JOIN action x ON x.attack_prediction_id = a.id"""
)
def stream_scored_attacks(spark, sf_dir):
    """Attack-profile messages into the result tables; predictions joined with their actions."""
    root = scratch_path(spark, "stream")
    messages = message_stream(attack_messages(V.read_table(spark, sf_dir, "orders")))
    score_stream(messages, root, f"{root}/checkpoint", **ALL).awaitTermination()
    attack = load_table(spark, "attack_predictions", root)
    action = load_table(spark, "self_healing_actions", root).select(
        F.col("attack_prediction_id").alias("id"), "action_type"
    )
    return attack.join(action, "id").select("created_at", "attack_type_name", "confidence", "action_type", "source")


@query(
    """SELECT t.created_at, t.prediction_score, t.is_attack, m.sender_ip FROM threat t
    JOIN events e ON e.event_id = t.id JOIN messages m ON m.id = t.id
    WHERE e.event_type <> 'view' AND m.sender_ip IN (SELECT ip_address FROM whitelist WHERE is_active)"""
)
def stream_external_messages(spark, sf_dir):
    """The external stream with source switch, whitelist and envelope; its prediction messages read back."""
    root = scratch_path(spark, "stream")
    write_dim(V.whitelist(spark, sf_dir), f"{root}/dims", "ip_whitelist")
    enabled = default_sources(spark).withColumn("is_enabled", F.col("is_enabled") | (F.col("source_name") == "external_kafka"))
    write_dim(enabled, f"{root}/dims", "data_source_config")
    score_external_stream(
        message_stream(external_messages(V.read_table(spark, sf_dir, "events")), external=True),
        f"{root}/dims",
        root,
        f"{root}/checkpoint",
        message_sink=file_message_sink(root),
        **ALL,
    ).awaitTermination()
    schema = "data struct<timestamp:timestamp_ntz,sender_ip:string,threat_prediction:struct<prediction_score:double,is_attack:boolean>>"
    data = spark.read.text(f"{root}/messages").select(F.from_json("value", schema)["data"].alias("data"))
    return data.select(
        F.col("data.timestamp").alias("created_at"),
        F.col("data.threat_prediction.prediction_score").alias("prediction_score"),
        F.col("data.threat_prediction.is_attack").alias("is_attack"),
        F.col("data.sender_ip").alias("sender_ip"),
    )


@query(
    """SELECT date_trunc('second', created_at) AS window_start, count(*) AS total, count(*) FILTER (is_attack) AS threats,
    count(*) - count(*) FILTER (is_attack) AS normal FROM threat GROUP BY 1"""
)
def stream_throughput(spark, sf_dir):
    """Windowed counts per second over the scored event stream; rows come in any order and none is too late."""
    root = scratch_path(spark, "stream")
    scored = scored_stream(spark, sf_dir)
    live.write_throughput(scored, root, f"{root}/checkpoint", **ALL).awaitTermination()
    return live.read_throughput(spark, root)


@query(
    """SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks, count(*) - count(*) FILTER (is_attack) AS normal,
    round(avg(prediction_score), 9) AS avg_threat_score
    FROM (SELECT * FROM threat ORDER BY created_at DESC, id DESC LIMIT 100)"""
)
def stream_rolling_stats(spark, sf_dir):
    """Stats over the 100 newest rows of the scored event stream."""
    root = scratch_path(spark, "stream")
    scored = scored_stream(spark, sf_dir)
    q = live.rolling_stats_stream(scored, root, f"{root}/checkpoint", **ALL)
    q.awaitTermination()
    last = spark.read.parquet(f"{root}/rolling/v{q.lastProgress['batchId']}")
    return last.withColumn("avg_threat_score", F.round("avg_threat_score", 9))


@query("SELECT id, prediction_score, 'Attack detected' AS alert FROM threat WHERE is_attack")
def stream_alerts(spark, sf_dir):
    """Alerts of the scored event stream."""
    root = scratch_path(spark, "stream")
    scored = scored_stream(spark, sf_dir)
    writer = live.alerts(scored).select("id", "prediction_score", "alert").writeStream.format("parquet")
    writer.option("path", f"{root}/alerts").option("checkpointLocation", f"{root}/checkpoint").trigger(**ALL).start().awaitTermination()
    return spark.read.parquet(f"{root}/alerts")


@query("SELECT id, src_bytes, prediction_score, is_attack FROM threat JOIN flow10 USING (id)")
def stream_csv_log(spark, sf_dir):
    """The scored event stream appended to a CSV log."""
    root = scratch_path(spark, "stream")
    scored = scored_stream(spark, sf_dir)
    rows = scored.select("id", "src_bytes", "prediction_score", "is_attack")
    live.log_stream(rows, f"{root}/log", f"{root}/checkpoint", **ALL).awaitTermination()
    return spark.read.schema(rows.schema).csv(f"{root}/log", header=True)


@query(
    """SELECT count(*) AS rows, count(*) AS ids, count(*) AS traffic, 2 AS loads_of_each_number
    FROM events WHERE event_type <> 'error'"""
)
def stream_two_checkpoints(spark, sf_dir):
    """Two streams of one source with checkpoints of their own into one root: no load replaces the other's."""
    root = scratch_path(spark, "stream")
    events = V.read_table(spark, sf_dir, "events")
    for half in (0, 1):
        messages = message_stream(threat_messages(events.where(F.col("event_id") % 2 == half)))
        score_stream(messages, root, f"{root}/checkpoint{half}", **ALL).awaitTermination()
    tables = load_tables(spark, root)
    number = F.regexp_extract("load_id", "-([0-9]+)-[a-z_]+$", 1)
    per_number = tables["threat"].groupBy(number.alias("number")).agg(F.count_distinct("load_id").alias("loads"))
    return tables["threat"].agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.lit(tables["traffic"].count()).alias("traffic"),
        F.lit(per_number.agg(F.min("loads")).first()[0]).cast("int").alias("loads_of_each_number"),
    )


@query(
    """SELECT t.created_at, t.prediction_score, t.is_attack, TRUE AS same_id FROM threat t
    JOIN events e ON e.event_id = t.id WHERE e.event_type <> 'error'"""
)
def stream_replayed_batch(spark, sf_dir):
    """A micro-batch replayed in other partitions: each row is there once, under the id it had."""
    root, before = scratch_path(spark, "stream"), scratch_path(spark, "before")
    messages = threat_messages(V.read_table(spark, sf_dir, "events"))
    score_batch(messages.repartition(3, "value"), 0, "realtime", root)
    load_table(spark, "threat_predictions", root).write.parquet(before)
    score_batch(messages.repartition(7, "timestamp"), 0, "realtime", root)
    columns = ["created_at", "prediction_score", "is_attack"]
    first = spark.read.parquet(before).select("id", *columns).withColumn("same_id", F.lit(True))
    again = load_table(spark, "threat_predictions", root).select("id", *columns)
    joined = again.join(first, ["id", *columns], "left")
    return joined.select(*columns, F.coalesce("same_id", F.lit(False)).alias("same_id"))


@query("SELECT 0 AS rows")
def stream_switched_off(spark, sf_dir):
    """The external stream while its source is disabled: every message is read, none is scored."""
    root = scratch_path(spark, "stream")
    write_dim(V.whitelist(spark, sf_dir), f"{root}/dims", "ip_whitelist")
    write_dim(default_sources(spark), f"{root}/dims", "data_source_config")
    messages = message_stream(external_messages(V.read_table(spark, sf_dir, "events")), external=True)
    score_external_stream(messages, f"{root}/dims", root, f"{root}/checkpoint", **ALL).awaitTermination()
    return load_table(spark, "threat_predictions", root).agg(F.count("*").cast("int").alias("rows"))


@query(
    """SELECT CASE WHEN action_description IS NOT NULL THEN 'action' WHEN is_attack THEN 'attack' ELSE 'normal' END AS type,
    count(*) AS "count" FROM live GROUP BY 1"""
)
def live_message_types(spark, sf_dir):
    """All live messages by the kind of log line they give."""
    kind = F.when(F.col("action_description").isNotNull(), "action").when(F.col("is_attack"), "attack").otherwise("normal")
    return live_messages(spark, sf_dir).groupBy(kind.alias("type")).agg(F.count("*").alias("count"))
