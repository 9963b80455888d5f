"""Live figures over a stream of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowward.operators.aggregates import rolling_stats, throughput
from flowward.operators.recent import top_recent
from flowward.session import remove_path
from flowward.sources.loads import stream_name

BUFFER_SCHEMA = "id bigint, created_at timestamp, prediction_score double, is_attack boolean"


def throughput_stream(
    stream: DataFrame, width: str = "1 second", delay: str = "10 seconds", time_col: str = "created_at"
) -> DataFrame:
    """total, threats and normal per tumbling window; state is dropped ``delay`` after a window has passed."""
    return throughput(stream.withWatermark(time_col, delay), width, time_col)


def write_throughput(
    stream: DataFrame, root: str, checkpoint: str, width: str = "1 second", time_col: str = "created_at", **trigger
) -> StreamingQuery:
    """Store each micro-batch's share of every window; `read_throughput` adds the shares up.

    Nothing is kept in memory between micro-batches and no row comes too late: a late one adds to its window.
    A replayed micro-batch replaces its share.
    """

    def handle(batch: DataFrame, number: int) -> None:
        name = stream_name(batch.sparkSession, checkpoint)
        throughput(batch, width, time_col).write.mode("overwrite").parquet(f"{root}/throughput/load={name}-{number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_throughput(spark: SparkSession, root: str) -> DataFrame:
    """The figures of every window so far."""
    shares = spark.read.parquet(f"{root}/throughput").groupBy("window_start")
    return shares.agg(*[F.sum(c).alias(c) for c in ("total", "threats", "normal")])


def compact_throughput(spark: SparkSession, root: str, into: str) -> None:
    """Write the figures of a stopped stream as one share under ``into``, in place of one per micro-batch."""
    read_throughput(spark, root).write.mode("overwrite").parquet(f"{into}/throughput/load=compacted")


def keep_buffer(batch: DataFrame, number: int, root: str, n: int = 100) -> None:
    """Merge a micro-batch into the buffer of the ``n`` newest rows and store it as version ``number``.

    Built from the version before, so a replay gives the same buffer.
    """
    spark = batch.sparkSession
    rows = batch.select("id", "created_at", "prediction_score", "is_attack")
    if number > 0:
        rows = top_recent(rows, n).unionByName(spark.read.schema(BUFFER_SCHEMA).parquet(f"{root}/buffer/v{number - 1}"))
    top_recent(rows, n).write.mode("overwrite").parquet(f"{root}/buffer/v{number}")
    if number > 1:  # a replay needs the version before, and no other
        remove_path(spark, f"{root}/buffer/v{number - 2}")


def rolling_stats_stream(stream: DataFrame, root: str, checkpoint: str, n: int = 100, **trigger) -> StreamingQuery:
    """Keep the ``n`` newest scored rows and their stats up to date under ``root``."""

    def handle(batch: DataFrame, number: int) -> None:
        keep_buffer(batch, number, root, n)
        buffer = batch.sparkSession.read.schema(BUFFER_SCHEMA).parquet(f"{root}/buffer/v{number}")
        rolling_stats(buffer, n).write.mode("overwrite").parquet(f"{root}/rolling/v{number}")
        if number > 1:
            remove_path(batch.sparkSession, f"{root}/rolling/v{number - 2}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def alerts(stream: DataFrame) -> DataFrame:
    """Attack rows only, with the alert text."""
    return stream.where("is_attack").withColumn("alert", F.lit("Attack detected"))


def log_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every scored row to a CSV log."""
    writer = (
        stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()
