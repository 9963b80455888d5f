"""Scoring with trained models: the same result columns as the rule scorers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from flowward.functions.labels import label_name
from flowward.functions.rules import is_attack
from flowward.ml.bundle import ModelBundle
from flowward.operators.scoring import ATTACK_COLUMNS, THREAT_COLUMNS
from flowward.profiles import DEFAULT_THRESHOLD, THREAT, FeatureProfile

# Confidence of a model that gives no class probabilities.
DEFAULT_CONFIDENCE = 0.85


def score_threat(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Probability of class 1 (or the plain prediction), the decision and the model version.

    Rows that cannot be scored have no score and no decision; see `unscored`.
    """
    out = bundle.apply(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    scored = out.withColumn("prediction_score", F.when(F.col("scorable"), score))
    return _threat_columns(df, scored, bundle.threshold, bundle.version)


def score_attack(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Predicted class, its name and the highest class probability; all null for rows that cannot be scored."""
    out = bundle.apply(df)
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(DEFAULT_CONFIDENCE)
    results = {"attack_type_encoded": F.col("prediction").cast("int"), "confidence": sure}
    scored = out.withColumns({c: F.when(F.col("scorable"), v) for c, v in results.items()})
    return _attack_columns(df, scored, bundle.labels, bundle.version)


def unscored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows, and those the model could not score."""
    column = "prediction_score" if "prediction_score" in scored.columns else "attack_type_encoded"
    return scored.where(F.col(column).isNotNull()), scored.where(F.col(column).isNull())


def _threat_columns(df: DataFrame, out: DataFrame, threshold: float, version: str) -> DataFrame:
    done = out.withColumns(
        {
            "is_attack": is_attack(F.col("prediction_score"), threshold),
            "threshold": F.lit(threshold),
            "model_version": F.lit(version),
        }
    )
    return done.select(*[f"`{c}`" for c in df.columns], *THREAT_COLUMNS)


def _attack_columns(df: DataFrame, out: DataFrame, labels: Sequence[str], version: str) -> DataFrame:
    done = out.withColumns(
        {"attack_type_name": label_name(F.col("attack_type_encoded"), list(labels)), "model_version": F.lit(version)}
    )
    return done.select(*[f"`{c}`" for c in df.columns], *ATTACK_COLUMNS)


def soft_vote(df: DataFrame, cols: Sequence[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Add the mean of several score columns and whether it is above the threshold."""
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))
    return df.withColumn("prediction_score", mean).withColumn(
        "is_attack", is_attack(F.col("prediction_score"), threshold)
    )


@dataclass(frozen=True)
class ProfileScorer:
    """Any model over any profile: a bundle, or a Python function over pandas feature frames.

    The function gets one Arrow batch of the profile's columns and returns a score
    per row (threat profiles) or a class code per row (attack profiles).
    """

    profile: FeatureProfile
    model: ModelBundle | Callable[[pd.DataFrame], pd.Series]
    threshold: float = DEFAULT_THRESHOLD
    version: str = "custom"
    finite_only: bool = True  # rows with a value that is no finite number go to quarantine

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.profile.columns if c not in df.columns]
        if missing:
            raise ValueError(f"Missing required features: {', '.join(missing)}")
        threat = self.profile.model_type == THREAT
        if isinstance(self.model, ModelBundle):
            return score_threat(df, self.model) if threat else score_attack(df, self.model)
        predict = self._vectorised()(F.struct(*self.profile.columns))
        if threat:
            return _threat_columns(df, df.withColumn("prediction_score", predict), self.threshold, self.version)
        coded = df.withColumns(
            {"attack_type_encoded": predict.cast("int"), "confidence": F.lit(DEFAULT_CONFIDENCE)}
        )
        return _attack_columns(df, coded, self.profile.class_labels, self.version)

    def _vectorised(self):
        model = self.model

        @F.pandas_udf("double")
        def predict(features: pd.DataFrame) -> pd.Series:
            return pd.Series(model(features)).astype("float64")

        return predict
