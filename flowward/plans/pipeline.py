"""Batch scoring: from a CSV upload to the four result tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.features import extract
from flowward.operators.joins import upload_load
from flowward.operators.scoring import rule_attack_class, rule_threat_score
from flowward.operators.validation import FAILFAST, not_finite_errors, validate
from flowward.profiles import ATTACK_PROFILE, THREAT, THREAT_LEGACY, FeatureProfile
from flowward.session import discard
from flowward.sources.flow_files import read_flows_csv, stamp
from flowward.sources.loads import first_id
from flowward.sources.tables import load_tables, write_scored


@dataclass(frozen=True)
class Scorer:
    """A profile and what scores rows that have its columns."""

    profile: FeatureProfile
    transform: Callable[[DataFrame], DataFrame]


def with_number_errors(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``errors`` with those values a trained model cannot take: a scorer says by ``finite_only`` that it is one."""
    if not getattr(scorer, "finite_only", False):
        return df
    return df.withColumn("errors", F.concat("errors", not_finite_errors(scorer.profile)))


RULE_SCORERS = (Scorer(THREAT_LEGACY, rule_threat_score), Scorer(ATTACK_PROFILE, rule_attack_class))


@dataclass(frozen=True)
class Upload:
    """What an upload produced: its batch id, the profile it followed, scored rows and refused rows.

    Both read ``stored``, a table in the scratch folder; `discard` removes it when they are no longer needed.
    """

    batch_id: str
    profile: FeatureProfile
    scored: DataFrame
    quarantined: DataFrame
    stored: DataFrame | None = None


def score_frame(
    raw: DataFrame,
    model_type: str = "auto",
    policy: str = FAILFAST,
    scorers: Sequence[Scorer] = RULE_SCORERS,
    batch_id: str | None = None,
    created_at: datetime | None = None,
    start_id: int = 0,
) -> Upload:
    """Detect the profile of a raw frame, extract, number, validate and score its rows."""
    by_profile = {s.profile.name: s for s in scorers}
    batch = batch_id or str(uuid.uuid4())
    scorable, profile = extract(raw, model_type, [s.profile for s in scorers])
    scorer = by_profile[profile.name]
    # Numbering stores the typed rows: a filter on rows that are not stored would be moved
    # below the parsing and repeat it.
    stamped = stamp(with_number_errors(scorable, scorer), "upload", batch, created_at, start_id)
    good, bad = validate(stamped, profile, policy)
    return Upload(batch, profile, scorer.transform(good), bad, stamped)


def score_upload(
    spark: SparkSession,
    path: str | Sequence[str],
    root: str,
    model_type: str = "auto",
    policy: str = FAILFAST,
    scorers: Sequence[Scorer] = RULE_SCORERS,
    created_at: datetime | None = None,
    batch_id: str | None = None,
) -> Upload:
    """Score a CSV file into the result tables under ``root``.

    With FAILFAST one bad row refuses the whole file before anything is stored.
    Refused rows of the DROP policy go to ``root/quarantine``. A re-run under the same
    ``batch_id`` replaces what the first run stored. The rows it returns are read back
    from the tables' own columns, so nothing stays in the scratch folder.
    """
    batch = batch_id or str(uuid.uuid4())
    raw = read_flows_csv(spark, path)
    start = first_id(spark, root, f"upload/{batch}")
    upload = score_frame(raw, model_type, policy, scorers, batch, created_at, start)
    write_scored(upload.scored, upload.profile, root, upload_load(batch))
    refused = f"{root}/quarantine/load_id={batch}"
    if policy != FAILFAST:
        told = upload.quarantined.select("id", "created_at", "source", "batch_id", "errors")
        told.write.mode("overwrite").parquet(refused)
        upload = replace(upload, quarantined=spark.read.schema(told.schema).parquet(refused))
    else:
        upload = replace(upload, quarantined=spark.createDataFrame([], upload.quarantined.schema))
    name = "threat" if upload.profile.model_type == THREAT else "attack"
    stored = load_tables(spark, root)[name]
    discard(upload.stored)
    return replace(upload, scored=stored.where(F.col("load_id") == upload_load(batch, upload.profile.model_type)), stored=None)
