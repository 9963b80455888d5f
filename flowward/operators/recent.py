"""Newest-first listings, bounded buffers and position numbers.

A listing is a sort with a limit, which Spark runs as a per-partition top-n and
a merge of those few rows. Ties on the time go to the larger id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowward.functions.labels import severity
from flowward.session import cut_lineage


def top_recent(df: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest rows, all of them if there are no more."""
    if n < 0:
        raise ValueError(f"{n} rows were asked for")
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def recent_threats(df: DataFrame, n: int = 100, attacks_only: bool = False, filter_first: bool = False) -> DataFrame:
    """Newest threat predictions; ``attacks_only`` filters after the limit unless ``filter_first``."""
    return _filtered(df, n, F.col("is_attack") if attacks_only else None, filter_first)


def recent_attacks(
    df: DataFrame, n: int = 100, attack_type: str | None = None, filter_first: bool = False
) -> DataFrame:
    """Newest attack predictions, optionally of one type (after the limit unless ``filter_first``)."""
    keep = None if attack_type is None else F.col("attack_type_name") == attack_type
    return _filtered(df, n, keep, filter_first)


def recent_actions(
    df: DataFrame, n: int = 100, action_type: str | None = None, filter_first: bool = False
) -> DataFrame:
    """Newest actions, optionally of one type (after the limit unless ``filter_first``)."""
    keep = None if action_type is None else F.col("action_type") == action_type
    return _filtered(df, n, keep, filter_first)


def _filtered(df: DataFrame, n: int, keep: Column | None, filter_first: bool) -> DataFrame:
    if keep is None:
        return top_recent(df, n)
    return top_recent(df.where(keep), n) if filter_first else top_recent(df, n).where(keep)


def last_n(df: DataFrame, n: int, order: str = "created_at") -> DataFrame:
    """The newest ``n`` rows of a display buffer (100 messages, 30 points, 50 log lines)."""
    ties = [F.col("id").desc()] if "id" in df.columns else []
    return df.orderBy(F.col(order).desc(), *ties).limit(n)


def threat_table(complete: DataFrame, n: int = 10) -> DataFrame:
    """Up to ``n`` attacks among the composite rows of the newest predictions, newest first."""
    return (
        complete.where("threat.is_attack")
        .orderBy(F.col("threat.created_at").desc(), F.col("threat.id").desc())
        .limit(n)
        .select(
            F.col("threat.id").alias("id"),
            F.col("threat.created_at").alias("created_at"),
            F.coalesce("attack.attack_type_name", F.lit("Unknown")).alias("attack_type"),
            F.coalesce(F.nullif(F.col("attack.confidence"), F.lit(0.0)), F.col("threat.prediction_score")).alias(
                "confidence"
            ),
            F.col("threat.prediction_score").alias("threat_score"),
            severity(F.col("threat.prediction_score")).alias("severity"),
        )
    )


def latest_per(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key.

    An aggregate, not a window: each task reduces a key to one row before the
    shuffle, so a key with a large share of the rows costs no more than others.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def list_dim(df: DataFrame, *order: str | Column) -> DataFrame:
    """A dimension in listing order (whitelist and models by newest, sources by name)."""
    return df.orderBy(*order)


# -- positions over a whole table ---------------------------------------------------


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with its partition as ``_part``.

    Rows that tie go by ``_tie``, so that they, too, are dealt over partitions: a hash of the row and of the partition
    it came from. Equal rows spread, and a task that runs again deals its rows as before.
    """
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    tied = df.withColumn("_tie", F.xxhash64(F.spark_partition_id(), *plain))
    return cut_lineage(tied.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Add running sums (inclusive) of columns in a total order over all rows; rows that tie have any order.

    ``sums`` maps a new column to the numeric column it adds up. The rows are
    range-partitioned by ``order`` and written once, so a row's partition number
    is settled; partition totals (one row per partition) then give each
    partition its starting value. No task sees more than its own partition.
    """
    ranged = _ranged(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part")
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        .select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in sums])
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        ranged.join(F.broadcast(starts), "_part")
        .withColumns({n: F.col(f"_start_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
        .drop("_part", "_tie", *[f"_start_{n}" for n in sums])
    )
    totals._cut_path = ranged._cut_path  # for `discard`, once nothing reads them any more
    return totals


def cumulative(df: DataFrame, order: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """Add ``cum_<col>`` running sums over the whole table."""
    return running_totals(df, order, {f"cum_{c}": c for c in cols})


def with_sequence(df: DataFrame, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """Number all rows from 1 in a total order (``order`` must not tie)."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"})
    numbered = counted.drop("_one")
    numbered._cut_path = counted._cut_path
    return numbered


def pct_change(df: DataFrame, order: str, col: str, name: str = "trend") -> DataFrame:
    """Percentage change to the previous row; null for the first row and after a null or zero.

    Each range of the order hands its last value on to the first row of the next one (one row a partition), so a
    series of any length is one window per partition. Rows that tie have any order.
    """
    ranged = _ranged(df, [order])
    last = F.max_by(F.struct(F.col(col).alias("value")), F.struct(order, "_tie")).alias("_last")
    lasts = ranged.groupBy("_part").agg(last)
    carried = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    inside = Window.partitionBy("_part").orderBy(order, "_tie")
    first = F.row_number().over(inside) == 1
    previous = F.when(first, F.col("_carried.value")).otherwise(F.lag(col).over(inside))
    changed = ranged.join(F.broadcast(carried), "_part").withColumn("_previous", previous)
    changed = changed.withColumn(name, F.try_divide((F.col(col) - F.col("_previous")) * F.lit(100.0), F.col("_previous")))
    return changed.drop("_part", "_tie", "_carried", "_previous")


def score_series(df: DataFrame, n: int = 100, threshold: float = 0.5) -> DataFrame:
    """Chart points of the ``n`` newest predictions: 1-based index (newest first), score and threshold line."""
    window = Window.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return top_recent(df, n).select(
        F.row_number().over(window).alias("index"),
        "id",
        "created_at",
        F.col("prediction_score").alias("score"),
        F.lit(threshold).alias("threshold"),
        "is_attack",
    )


def shuffle_rows(df: DataFrame, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """All rows in a pseudo-random order fixed by the seed.

    Sorted by a hash of the row, so a re-run task puts the same rows in the same place.
    """
    cols = list(key or df.columns)
    return df.orderBy(F.xxhash64(F.lit(seed), *cols), *cols)
