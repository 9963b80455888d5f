"""Rows as the live log and the history table show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowward.operators.recent import top_recent


def log_lines(messages: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest messages as log lines of type action, attack or normal.

    Every attack prediction carries an action, so its line is an action line,
    benign or not.
    """
    has_action = F.col("action_description").isNotNull()
    attack = F.coalesce("is_attack", F.lit(False)) | F.col("attack_type_name").isNotNull()
    number = F.col("traffic_data_id").cast("string")
    return top_recent(messages, n).select(
        "id",
        "created_at",
        F.when(has_action, "action").when(attack, "attack").otherwise("normal").alias("type"),
        F.when(has_action, F.col("action_description"))
        .when(attack, F.concat(F.lit("Attack detected from traffic_id "), number))
        .otherwise(F.concat(F.lit("Normal traffic analyzed - traffic_id "), number))
        .alias("message"),
        F.col("prediction_score").alias("score"),
        F.when(~has_action, F.col("attack_type_name")).alias("attack_type"),
        F.when(~has_action, F.col("confidence")).alias("confidence"),
    )


def history_rows(complete: DataFrame) -> DataFrame:
    """Composite rows as history lines: score to three decimals, status, type or ``-``, confidence in percent or ``-``."""
    confidence = F.nullif(F.col("attack.confidence"), F.lit(0.0))
    return complete.select(
        F.col("traffic.id").alias("id"),
        F.col("threat.created_at").alias("created_at"),
        F.format_string("%.3f", "threat.prediction_score").alias("score"),
        F.when(F.col("threat.is_attack"), "Attack").otherwise("Normal").alias("status"),
        F.coalesce("attack.attack_type_name", F.lit("-")).alias("attack_type"),
        F.coalesce(F.when(confidence.isNotNull(), F.format_string("%.1f%%", confidence * 100)), F.lit("-")).alias(
            "confidence"
        ),
    )
