"""A copy of the result tables bucketed by traffic row: composite rows without a shuffle, however often they are read.

The tables are shuffled once, when the copy is written. An action is stored with its attack prediction, as it is found
by that prediction's id and not by the traffic row's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from flowward.operators.joins import composite_parts, composed

PARTS = ("traffic", "threat", "attack")


def _folder(path: str, buckets: int, part: str) -> str:
    return f"{path}/buckets={buckets}/{part}"


def _table(folder: str) -> str:
    return "bucketed_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def write_bucketed(tables: dict[str, DataFrame], path: str, buckets: int) -> None:
    """Write one version of the four result tables under ``path``, one sorted file a bucket and part.

    Keys are ids of single rows, so buckets are even. Predictions without a traffic row belong to no composite row and
    are left out.
    """
    for part, rows in composite_parts(**tables).items():
        folder = _folder(path, buckets, part)
        dealt = rows.where("_key IS NOT NULL").repartition(buckets, "_key")
        writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "_key").sortBy("_key")
        writer.option("path", folder).saveAsTable(_table(folder))


def _open(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """A part as a table of this session's catalog; another session's tables are not in it."""
    name = _table(folder)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (_key) SORTED BY (_key) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(name)


def bucketed_complete(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The composite rows of a bucketed copy; buckets are merged where they lie.

    ``buckets`` is the number the copy was written with; another one finds no folder.
    """
    traffic, threat, attack = (_open(spark, _folder(path, buckets, part), buckets) for part in PARTS)
    return composed(traffic, threat.hint("merge"), attack.hint("merge"))
