"""Frames that several catalog queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.scoring import attach_actions
from flowward.sources.flow_views import result_tables


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat and attack predictions as one feed of live messages; ids are interleaved to stay unique."""
    t = result_tables(spark, sf_dir)
    threats = t["threat"].select(
        (F.col("id") * 2).alias("id"),
        (F.col("id") * 2).alias("traffic_data_id"),
        "created_at",
        "prediction_score",
        "is_attack",
    )
    attacks = attach_actions(t["attack"]).select(
        (F.col("id") * 2 + 1).alias("id"),
        (F.col("id") * 2 + 1).alias("traffic_data_id"),
        "created_at",
        "attack_type_name",
        "confidence",
        "action_description",
    )
    return threats.unionByName(attacks, allowMissingColumns=True)


def flatten_complete(df: DataFrame) -> DataFrame:
    """Composite rows as plain columns."""
    return df.select(
        F.col("traffic.id").alias("id"),
        F.col("traffic.source").alias("source"),
        F.col("traffic.batch_id").alias("batch_id"),
        F.col("threat.prediction_score").alias("prediction_score"),
        F.col("threat.is_attack").alias("is_attack"),
        F.col("attack.attack_type_name").alias("attack_type_name"),
        F.col("attack.confidence").alias("confidence"),
        F.col("action.action_type").alias("action_type"),
    )
