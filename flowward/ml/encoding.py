"""Integer codes for text columns and class labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowward.functions.labels import label_name
from flowward.operators.joins import dim_lookup
from flowward.operators.recent import with_sequence

MISSING = "nan"


def fit_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): per column its distinct values in alphabetical order, from 0; nulls count as ``nan``.

    The values are numbered as one sorted table, so a column with very many
    values is spread over tasks as well.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias("value")) for c in cols]
    )
    values = df.select(F.inline(pairs)).distinct()
    numbered = with_sequence(values, ["column", "value"], "_n")
    first = numbered.groupBy("column").agg(F.min("_n").alias("_first"))
    return numbered.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_n") - F.col("_first")).cast("int").alias("code")
    )


def encode(df: DataFrame, encoder: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace text columns by their codes as doubles; a value the encoder lacks gives null."""
    out = df
    for c in cols:
        codes = encoder.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        keyed = out.withColumn("_value", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)))
        out = dim_lookup(keyed, codes, "_value").withColumn(c, F.col("_code").cast("double")).drop("_value", "_code")
    return out.select(*[f"`{c}`" for c in df.columns])


def encode_target(label: Column, normal: str = "normal") -> Column:
    """1.0 for an attack, 0.0 for the normal class; stated outright so that it cannot flip with the alphabet."""
    return F.when(label == normal, 0.0).otherwise(1.0)


def decode_labels(df: DataFrame, col: str, labels: Sequence[str], name: str = "label_name") -> DataFrame:
    """Add the class name of a code column."""
    return df.withColumn(name, label_name(F.col(col), list(labels)))
