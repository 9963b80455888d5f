"""Flow records from CSV files, stamped with ids and batch data."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.features import FeatureError
from flowward.operators.sets import union_all
from flowward.profiles import fixed_table
from flowward.session import cut_lineage, discard

# `monotonically_increasing_id` gives the position inside a partition in its low bits.
_POSITION_BITS = 33
# Bits of a row id that are its own, the rest is its load's.
_LOAD_ROOM = 37


def read_flows_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A CSV with header as text columns; values become numbers in `operators.features.extract`.

    Type inference is left out: it would cost a pass over the data and turn
    infinities into text or nulls. Only ``.csv`` paths are taken and a file
    without rows is refused.
    """
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not p.rstrip("/").endswith(".csv"):
            raise FeatureError(f"Only CSV files are supported: {p}")
    df = spark.read.csv(paths, header=True, inferSchema=False, enforceSchema=False, mode="FAILFAST")
    if df.isEmpty():
        raise FeatureError("CSV file is empty")
    return df


def read_many_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several CSV files as one frame, matched by column name; files with equal headers are read together."""
    by_header: dict[str, list[str]] = {}
    for p in paths:
        if not p.rstrip("/").endswith(".csv"):
            raise FeatureError(f"Only CSV files are supported: {p}")
        first = spark.read.text(p).first()
        by_header.setdefault(first[0] if first else "", []).append(p)
    return union_all(*[read_flows_csv(spark, group) for group in by_header.values()])


def stamp(
    df: DataFrame,
    source: str = "upload",
    batch_id: str | None = None,
    created_at: datetime | None = None,
    start_id: int = 0,
) -> DataFrame:
    """Add id, created_at, source and batch_id.

    One batch id and one time for the whole batch, as plain values, so that every
    table written from it agrees. Rows are always numbered anew.
    """
    at = created_at or datetime.now(timezone.utc)
    numbered = with_dense_ids(df.drop("id"), start_id)
    stamped = numbered.withColumns(
        {
            "created_at": F.lit(at).cast("timestamp"),
            "source": F.lit(source),
            "batch_id": F.lit(batch_id or (str(uuid.uuid4()) if source == "upload" else None)).cast("string"),
        }
    )
    stamped._cut_path = numbered._cut_path
    return stamped


def with_dense_ids(df: DataFrame, start_id: int = 0) -> DataFrame:
    """Number rows start_id, start_id + 1, ... in partition and row order.

    The rows are written once with their position, so that a row keeps its
    number; the driver adds up one number per partition. No shuffle of the rows.
    """
    placed = cut_lineage(
        df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered"
    )
    low_bits = F.col("_row").bitwiseAND(F.lit(2**_POSITION_BITS - 1))
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = [0, *itertools.accumulate(n for _, n in sizes)][: len(sizes)]
    starts = fixed_table(
        df.sparkSession, {"_part": [p for p, _ in sizes], "_start": before}, {"_part": pa.int32(), "_start": pa.int64()}
    )
    numbered = placed.join(F.broadcast(starts), "_part").select(
        (low_bits + F.col("_start") + F.lit(start_id)).alias("id"), *[f"`{c}`" for c in df.columns]
    )
    numbered._cut_path = placed._cut_path
    return numbered


def with_content_ids(df: DataFrame, order: Sequence[str], start_id: int = 0) -> DataFrame:
    """Number rows from ``start_id`` in the order of their content, whatever partitions they come in.

    Rows that are equal in ``order`` take numbers of their own in no fixed order, so ``order`` has to hold
    everything in which rows differ. They may be many: they are split over tasks like any others.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return with_dense_ids(ranged.drop("_tie"), start_id)


def with_offset_ids(df: DataFrame, otherwise: Sequence[str], start_id: int = 0, room: int = 2**_LOAD_ROOM) -> DataFrame:
    """Number rows by (topic, partition, offset), which the result leaves out, without moving them.

    The driver lays the offset ranges of the topics' partitions one after the other, one row for each. Rows are written
    once, so that they are read from the source once. Where a place is missing, or the ranges leave gaps so wide that
    they do not fit into ``room``, rows are numbered in the order of ``otherwise``.
    """
    placed = cut_lineage(df, "placed")
    columns = [c for c in df.columns if c not in ("topic", "partition", "offset")]
    lacking = F.col("topic").isNull() | F.col("partition").isNull() | F.col("offset").isNull()
    ranges = placed.groupBy("topic", "partition").agg(F.min("offset"), F.max("offset"), F.count_if(lacking)).collect()
    missing = any(r[4] for r in ranges)
    if missing or sum(r[3] - r[2] + 1 for r in ranges) > room:
        numbered = with_content_ids(placed, otherwise, start_id)
        discard(placed)
        kept = numbered.select("id", *columns)
        kept._cut_path = numbered._cut_path
        return kept
    starts = []
    for topic, partition, low, high, _ in sorted(map(tuple, ranges)):
        starts.append((topic, partition, start_id - low))
        start_id += high - low + 1
    names = {"topic": pa.string(), "partition": pa.int32(), "_start": pa.int64()}
    table = fixed_table(df.sparkSession, {name: [s[i] for s in starts] for i, name in enumerate(names)}, names)
    numbered = placed.join(F.broadcast(table), ["topic", "partition"])
    numbered = numbered.select((F.col("offset") + F.col("_start")).alias("id"), *columns)
    numbered._cut_path = placed._cut_path
    return numbered
