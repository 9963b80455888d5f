"""Row filters; every one is a predicate that the scan can take."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F


def upload_batches(traffic: DataFrame) -> DataFrame:
    """Rows that came in by file upload as part of a batch."""
    return traffic.where((F.col("source") == "upload") & F.col("batch_id").isNotNull())


def batch_rows(traffic: DataFrame, batch_id: str) -> DataFrame:
    """All rows of one upload batch."""
    return traffic.where(F.col("batch_id") == batch_id)


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The rows whose ``key`` equals ``value``."""
    return df.where(F.col(key) == F.lit(value))


def active_only(df: DataFrame) -> DataFrame:
    return df.where("is_active")


def last_second(df: DataFrame, now, time_col: str = "created_at") -> DataFrame:
    """Rows newer than one second before ``now`` (a timestamp literal or column)."""
    return df.where(F.col(time_col) > F.lit(now) - F.expr("INTERVAL 1 SECOND"))
