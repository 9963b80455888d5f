"""Scored rows from feature columns, and the response action each attack calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowward.functions.labels import label_name
from flowward.functions.rules import (
    ATTACK_NOISE,
    THREAT_NOISE,
    attack_class,
    digest_mod,
    feature_digest,
    rule_confidence,
    threat_score,
)
from flowward.profiles import (
    ATTACK_PROFILE,
    DEFAULT_THRESHOLD,
    RULE_ATTACK_VERSION,
    RULE_THREAT_VERSION,
    THREAT_LEGACY,
    action_dim,
)

THREAT_COLUMNS = ["prediction_score", "is_attack", "threshold", "model_version"]
ATTACK_COLUMNS = ["attack_type_encoded", "attack_type_name", "confidence", "model_version"]
ACTION_COLUMNS = ["action_type", "action_description", "action_params"]


def rule_threat_score(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Add the rule score of ``threat_legacy`` columns, the decision and the model version."""
    return (
        df.withColumn("_noise", digest_mod(feature_digest(THREAT_LEGACY.columns), THREAT_NOISE))
        .withColumn("prediction_score", threat_score(F.col("_noise")))
        .drop("_noise")
        .withColumns(
            {
                # A rule score is never NaN, so the plain comparison does.
                "is_attack": F.col("prediction_score") > threshold,
                "threshold": F.lit(threshold),
                "model_version": F.lit(RULE_THREAT_VERSION),
            }
        )
    )


def rule_attack_class(df: DataFrame) -> DataFrame:
    """Add the rule class, name and confidence of attack-profile columns and the model version."""
    return (
        df.withColumn("_noise", digest_mod(feature_digest(ATTACK_PROFILE.columns), ATTACK_NOISE))
        .withColumns(
            {
                "attack_type_encoded": attack_class(F.col("_noise")),
                "confidence": rule_confidence(F.col("_noise")),
            }
        )
        .drop("_noise")
        .withColumns(
            {
                "attack_type_name": label_name(F.col("attack_type_encoded")),
                "model_version": F.lit(RULE_ATTACK_VERSION),
            }
        )
    )


def attach_actions(attacks: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Look the action up by attack name; unknown names are only logged.

    The built-in action table has one row per known name, so it is broadcast;
    a table passed in is left to the planner.
    """
    dim = F.broadcast(action_dim(attacks.sparkSession)) if actions is None else actions
    joined = attacks.join(dim, "attack_type_name", "left")
    known = F.col("action_type").isNotNull()
    return joined.withColumns(
        {
            "action_description": F.when(known, F.col("action_description")).otherwise(
                F.concat(F.lit("No action defined for "), F.col("attack_type_name"))
            ),
            "action_params": F.when(known, F.col("action_params")).otherwise(
                F.create_map().cast("map<string,string>")
            ),
            "action_type": F.coalesce("action_type", F.lit("log_only")),
        }
    )


def action_rows(attacks: DataFrame, actions: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The self-healing action record of each attack prediction (recorded, never executed).

    ``keep`` names further columns to take over.
    """
    return attach_actions(attacks, actions).select(
        F.col("id"),
        F.col("id").alias("attack_prediction_id"),
        "created_at",
        *ACTION_COLUMNS,
        F.lit("logged").alias("status"),
        F.col("created_at").alias("execution_time"),
        F.lit(None).cast("string").alias("error_message"),
        *keep,
    )
