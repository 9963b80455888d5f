"""Classifiers of the two training recipes, as MLlib pipelines over named columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from flowward.ml.forest import fit_forest
from flowward.ml.network import fit_network

FEATURES = "_features"


def _fit(df: DataFrame, features: Sequence[str], classifier) -> PipelineModel:
    # "keep": a row with a value that is no number is scored as it is, never the end of a job;
    # the bundle takes its score away. Such rows are not trained on.
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")
    return Pipeline(stages=[assembler, classifier]).fit(_numbers(df, features))


def _numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all numbers."""
    return df.where(
        reduce(lambda a, b: a & b, [F.col(f"`{f}`").isNotNull() & ~F.isnan(F.col(f"`{f}`").cast("double")) for f in features])
    )


def train_forest(
    df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 15, seed: int = 42
) -> PipelineModel:
    """Random forest."""
    return fit_forest(_numbers(df, features), features, label, trees, depth, seed)


def train_tree(
    df: DataFrame, features: Sequence[str], label: str = "label", depth: int = 12, seed: int = 42
) -> PipelineModel:
    """Decision tree on entropy."""
    return _fit(
        df,
        features,
        DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, impurity="entropy", maxDepth=depth, seed=seed),
    )


def train_mlp(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    hidden: Sequence[int] = (128, 128, 64, 32),
    classes: int = 2,
    epochs: int = 100,
    seed: int = 42,
) -> PipelineModel:
    """Dense network with sigmoid layers."""
    return fit_network(_numbers(df, features), features, label, [len(features), *hidden, classes], epochs, seed)
