"""A trained model with everything needed to score with it, as one artifact."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.ml.encoding import encode
from flowward.ml.scaling import Scaling
from flowward.profiles import DEFAULT_THRESHOLD


@dataclass(frozen=True)
class ModelBundle:
    """Model, scaling, category codes, selected features, class labels, threshold and metadata.

    ``features`` are the columns the model was trained on, in order.
    """

    model: PipelineModel
    features: tuple[str, ...]
    labels: tuple[str, ...]
    scaling: Scaling | None = None
    encoder: DataFrame | None = None
    encoded: tuple[str, ...] = ()
    threshold: float = DEFAULT_THRESHOLD
    metadata: dict = field(default_factory=dict)

    @property
    def version(self) -> str:
        return str(self.metadata.get("version", "unknown"))

    def prepare(self, df: DataFrame) -> DataFrame:
        """Encode and scale copies of the feature columns; the originals stay as they are."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"Missing required features: {', '.join(missing)}")
        return df if self.encoder is None else encode(df, self.encoder, self.encoded)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the model's output columns and ``scorable``.

        A row with a feature that is null, NaN or a word the encoder lacks is not scorable; what the
        model says of it means nothing.
        """
        rows = self.prepare(df.withColumns({f"_own_{f}": df[f"`{f}`"] for f in self.features if f in df.columns}))
        kept = rows.withColumns({f"_raw_{f}": rows[f"`{f}`"] for f in self.features})
        scaled = self.scaling.transform(kept) if self.scaling else kept
        out = self.model.transform(scaled)
        known = F.lit(True)
        for f in self.features:
            known = known & out[f"`_raw_{f}`"].isNotNull() & ~F.isnan(out[f"`_raw_{f}`"].cast("double"))
        out = out.withColumn("scorable", known)
        return out.withColumns({f: out[f"`_own_{f}`"] for f in self.features}).drop(
            *[f"{mark}{f}" for f in self.features for mark in ("_raw_", "_own_")], "_features"
        )


def save_bundle(bundle: ModelBundle, path: str, spark: SparkSession) -> None:
    """Write the bundle under ``path``, replacing what is there."""
    bundle.model.write().overwrite().save(f"{path}/model")
    about = {
        "features": bundle.features,
        "labels": bundle.labels,
        "scaling": asdict(bundle.scaling) if bundle.scaling else None,
        "encoded": bundle.encoded,
        "threshold": bundle.threshold,
        "metadata": bundle.metadata,
    }
    if bundle.encoder is not None:
        bundle.encoder.write.mode("overwrite").parquet(f"{path}/encoder")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    """Read a bundle written by `save_bundle`."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    scaling = about["scaling"]
    return ModelBundle(
        model=PipelineModel.load(f"{path}/model"),
        features=tuple(about["features"]),
        labels=tuple(about["labels"]),
        scaling=Scaling(*(tuple(scaling[k]) for k in ("columns", "center", "width"))) if scaling else None,
        encoder=spark.read.parquet(f"{path}/encoder") if about["encoded"] else None,
        encoded=tuple(about["encoded"]),
        threshold=about["threshold"],
        metadata=about["metadata"],
    )
