"""Unions and repeatable splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name; a column one lacks is null there."""
    return reduce(lambda a, b: a.select("*").unionByName(b, allowMissingColumns=True), dfs)


def split_point(key: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the key value and the seed."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def split(df: DataFrame, weights: Sequence[float], seed: int = 42, key: str = "id") -> list[DataFrame]:
    """Disjoint parts that cover all rows, in the given proportions.

    A row's part depends on its key and the seed only, so re-run tasks and other
    partitionings give the same parts.
    """
    total = sum(weights)
    point = split_point(key, seed)
    edges = [0.0]
    for w in weights:
        edges.append(edges[-1] + w / total)
    edges[-1] = 1.0
    return [df.where((point >= lo) & (point < hi)) for lo, hi in zip(edges, edges[1:])]
