"""The two training recipes from labelled records to a bundle and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from flowward.ml.bundle import ModelBundle
from flowward.ml.encoding import encode, encode_target, fit_encoder
from flowward.ml.scaling import fit_robust, fit_standard
from flowward.ml.scorers import score_attack, score_threat
from flowward.ml.selection import drop_correlated, rfe
from flowward.ml.training import train_forest, train_tree
from flowward.operators.evaluation import accuracy, evaluate
from flowward.operators.features import drop_columns
from flowward.operators.profiling import numeric_columns, text_columns
from flowward.operators.sets import split
from flowward.operators.validation import drop_invalid
from flowward.session import cut_lineage

UNUSED = "num_outbound_cmds"


def _version() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with a key to split by, written once so that every pass sees the same keys."""
    return cut_lineage(df if "id" in df.columns else df.withColumn("id", F.monotonically_increasing_id()), "training")


def train_threat_detector(
    df: DataFrame,
    label: str = "class",
    normal: str = "normal",
    k: int = 10,
    trees: int = 100,
    depth: int = 15,
    rfe_trees: int = 50,
    scale_before_split: bool = False,
    seed: int = 42,
) -> tuple[ModelBundle, dict[str, DataFrame]]:
    """Drop unlabelled rows, encode text, select ``k`` features, split 80/20, scale, fit a forest, evaluate.

    The scaling is fitted on the training rows; ``scale_before_split`` fits it on all rows.
    """
    clean = _keyed(drop_columns(df.where(F.col(label).isNotNull()), UNUSED))
    texts = [c for c in text_columns(clean) if c != label]
    encoder = fit_encoder(clean, texts) if texts else None
    rows = clean.withColumn("label", encode_target(F.col(label), normal)).drop(label)
    coded = encode(rows, encoder, texts) if texts else rows
    columns = [c for c in numeric_columns(coded) if c not in ("label", "id")]
    selected = rfe(coded, columns, "label", k, rfe_trees, seed=seed)
    train, test = split(coded, [0.8, 0.2], seed)
    scaling = fit_standard(coded if scale_before_split else train, selected)
    model = train_forest(scaling.transform(train), selected, "label", trees, depth, seed)
    used = [c for c in texts if c in selected]
    bundle = ModelBundle(
        model=model,
        features=tuple(selected),
        labels=("Normal", "Attack"),
        scaling=scaling,
        encoder=encoder.where(F.col("column").isin(used)) if used else None,
        encoded=tuple(used),
        metadata=_metadata("RandomForestClassifier", train, test, selected),
    )
    plain = ModelBundle(model, bundle.features, bundle.labels, scaling, metadata=bundle.metadata)
    scored = score_threat(test, plain).withColumn("prediction", F.col("is_attack").cast("double"))
    scored = cut_lineage(scored.select("label", "prediction", "prediction_score"), "scored")
    return _measured(bundle, scored), evaluate(scored, "label", "prediction", "prediction_score")


def train_attack_classifier(
    df: DataFrame,
    label: str = " Label",
    depth: int = 12,
    threshold: float = 0.85,
    scale_before_split: bool = False,
    weights: Sequence[float] = (0.8, 0.2),
    seed: int = 42,
) -> tuple[ModelBundle, dict[str, DataFrame]]:
    """Drop rows with missing or infinite values, encode the label, drop correlated features, split, scale, fit a tree.

    ``weights`` are the parts of the split; the last one is the test part. The
    bundle carries its own label order (alphabetical).
    """
    clean = _keyed(drop_invalid(df))
    codes = fit_encoder(clean, [label])
    labels = [r["value"] for r in codes.orderBy("code").collect()]
    rows = encode(clean, codes, [label]).withColumnRenamed(label, "label")
    columns = [c for c in numeric_columns(rows) if c not in ("label", "id")]
    kept, _ = drop_correlated(rows, columns, threshold)
    parts = split(rows, weights, seed)
    train, test = parts[0], parts[-1]
    scaling = fit_robust(rows if scale_before_split else train, kept)
    model = train_tree(scaling.transform(train), kept, "label", depth, seed)
    bundle = ModelBundle(
        model=model,
        features=tuple(kept),
        labels=tuple(labels),
        scaling=scaling,
        metadata=_metadata("DecisionTreeClassifier", train, test, kept) | {"n_classes": len(labels)},
    )
    scored = score_attack(test, bundle).withColumn("prediction", F.col("attack_type_encoded").cast("double"))
    return _measured(bundle, scored), evaluate(scored, "label", "prediction")


def _metadata(kind: str, train: DataFrame, test: DataFrame, features: list[str]) -> dict:
    return {
        "version": _version(),
        "n_samples_train": train.count(),
        "n_samples_test": test.count(),
        "n_features": len(features),
        "model_type": kind,
        "created_at": datetime.now(timezone.utc).isoformat(),
    }


def _measured(bundle: ModelBundle, scored: DataFrame) -> ModelBundle:
    share = accuracy(scored, "label", "prediction").first()[0]
    return ModelBundle(**(vars(bundle) | {"metadata": bundle.metadata | {"accuracy": share}}))
