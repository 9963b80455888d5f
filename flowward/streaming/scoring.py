"""Scoring of message streams, one micro-batch at a time with the batch operators.

A micro-batch is decoded, gated, parsed, numbered and written once to the shared
folder; everything after reads that table. All outputs are stored per micro-batch and
overwritten when it is replayed, so a restart repeats nothing and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowward.operators.features import detect_profile_col, message_values, value_columns
from flowward.operators.joins import admitted_flag, gate_sources
from flowward.operators.sets import union_all
from flowward.operators.validation import with_errors
from flowward.plans.pipeline import RULE_SCORERS, Scorer, with_number_errors
from flowward.session import cut_lineage, discard
from flowward.sources.flow_files import with_content_ids, with_offset_ids
from flowward.sources.loads import first_id, stream_name
from flowward.sources.messages import decode_messages, sender_ip, unwrap
from flowward.sources.tables import prediction_structs, read_dim, to_prediction_messages, write_scored

REALTIME = "realtime"
EXTERNAL = "external_kafka"

MessageSink = Callable[[DataFrame, str], None]


def file_message_sink(root: str) -> MessageSink:
    """Prediction messages as text files, one folder per load."""

    def write(messages: DataFrame, load_id: str) -> None:
        messages.write.mode("overwrite").text(f"{root}/messages/load_id={load_id}")

    return write


def kafka_message_sink(**options: str) -> MessageSink:
    """Prediction messages to Kafka; a replayed micro-batch may send them again."""

    def write(messages: DataFrame, load_id: str) -> None:
        messages.write.format("kafka").options(**({"topic": "predictions"} | options)).save()

    return write


def detected(decoded: DataFrame, scorers: Sequence[Scorer]) -> DataFrame:
    """Add ``profile`` (null when unknown) and ``reason`` for messages that cannot be scored."""
    profile = detect_profile_col(F.col("payload"), [s.profile for s in scorers])
    return decoded.withColumn("profile", profile).withColumn(
        "reason",
        F.when(F.col("payload").isNull(), "not a JSON object").when(
            F.col("profile").isNull(), "record type not recognised"
        ),
    )


def score_numbered(numbered: DataFrame, scorers: Sequence[Scorer]) -> tuple[list[tuple[Scorer, DataFrame]], DataFrame]:
    """Per scorer the scored rows of its profile, and all rows that are left out with the reason."""
    told = ["id", "created_at", "source", "text"]
    scored, refused = [], [numbered.where(F.col("reason").isNotNull()).select(*told, "reason")]
    for s in scorers:
        rows = numbered.where(F.col("reason").isNull() & (F.col("profile") == s.profile.name))
        checked = with_errors(with_number_errors(value_columns(rows, s.profile), s), s.profile)
        scored.append((s, s.transform(checked.where("valid").drop("errors", "valid"))))
        refused.append(checked.where(~F.col("valid")).select(*told, F.array_join("errors", "; ").alias("reason")))
    return scored, union_all(*refused)


def score_batch(
    batch: DataFrame,
    batch_number: int,
    source: str,
    root: str,
    scorers: Sequence[Scorer] = RULE_SCORERS,
    message_sink: MessageSink | None = None,
    dims_root: str | None = None,
    stream: str = "batch",
) -> None:
    """Score one micro-batch into the result tables, the message sink and ``root/quarantine``.

    ``stream`` names the stream that the batch number belongs to: streams with checkpoints of
    their own share a root without overwriting each other. Row ids follow from the load and the
    messages' place in the source (topic, partition and offset, else their content), so a replay
    gives the same ones however it is partitioned. With ``dims_root`` the source switch and the
    whitelist are read anew, so that a change takes effect with the next micro-batch.
    """
    spark = batch.sparkSession
    at: Column = F.coalesce("timestamp", F.current_timestamp()) if "timestamp" in batch.columns else F.current_timestamp()
    places = [c for c in ("topic", "partition", "offset") if c in batch.columns]
    decoded = decode_messages(batch).withColumns(
        {"source": F.lit(source), "created_at": at.cast("timestamp"), "sender_ip": F.lit(None).cast("string")}
    )
    if dims_root is not None:
        decoded = gate_sources(decoded, read_dim(spark, dims_root, "data_source_config"))
        decoded = decoded.withColumn("sender_ip", sender_ip(decoded))
        decoded = unwrap(admitted_flag(decoded, read_dim(spark, dims_root, "ip_whitelist")))
    else:
        decoded = decoded.withColumn("admitted", F.lit(True))
    wanted = detected(decoded, scorers).withColumn(
        "reason", F.when(~F.col("admitted"), "sender not on the whitelist").otherwise(F.col("reason"))
    )
    parsed = message_values(wanted, [s.profile for s in scorers])
    columns = ["created_at", "source", "sender_ip", "text", "profile", "reason", "_values", "errors"]
    load_id = f"{source}-{stream}-{batch_number}"
    start = first_id(spark, root, load_id)
    content = ["created_at", "text", "sender_ip", "reason"]
    if len(places) == 3:
        numbered = with_offset_ids(parsed.select(*columns, *places), [*places, *content], start)
    else:
        numbered = with_content_ids(parsed.select(*columns), content, start)
    rows_of_batch = numbered.withColumn("batch_id", F.lit(None).cast("string"))

    # At most one value per scorer; a scorer without rows is left out.
    present = {r["profile"] for r in rows_of_batch.select("profile").distinct().collect()}
    scored, refused = score_numbered(rows_of_batch, [s for s in scorers if s.profile.name in present])
    scored = [(s, cut_lineage(rows, "scored")) for s, rows in scored]
    for s, rows in scored:
        write_scored(rows, s.profile, root, load_id)
    if message_sink is not None and scored:
        structs = [prediction_structs(rows, s.profile) for s, rows in scored]
        message_sink(to_prediction_messages(union_all(*structs)), load_id)
    refused.write.mode("overwrite").parquet(f"{root}/quarantine/load_id={load_id}")
    discard(numbered, *[rows for _, rows in scored])


def score_stream(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    scorers: Sequence[Scorer] = RULE_SCORERS,
    message_sink: MessageSink | None = None,
    **trigger,
) -> StreamingQuery:
    """Start scoring the internal stream; ``trigger`` as in ``DataStreamWriter.trigger``."""
    return _start(stream, checkpoint, trigger, REALTIME, root, scorers, message_sink, None)


def score_external_stream(
    stream: DataFrame,
    dims_root: str,
    root: str,
    checkpoint: str,
    scorers: Sequence[Scorer] = RULE_SCORERS,
    message_sink: MessageSink | None = None,
    **trigger,
) -> StreamingQuery:
    """Start scoring the external stream: only from whitelisted senders and while the source is enabled."""
    return _start(stream, checkpoint, trigger, EXTERNAL, root, scorers, message_sink, dims_root)


def _start(stream, checkpoint, trigger, source, root, scorers, message_sink, dims_root) -> StreamingQuery:
    def handle(batch: DataFrame, number: int) -> None:
        name = stream_name(batch.sparkSession, checkpoint)
        score_batch(batch, number, source, root, scorers, message_sink, dims_root, name)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
