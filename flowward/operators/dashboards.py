"""Partial figures of the dashboards, written with each load and merged when a dashboard reads them.

Cells count a load's rows by hour, batch and label: a few dozen rows a load, however large it is. The newest
predictions of each load are kept whole, as many as a page shows at most. Merged over all loads both give what a scan
of the result tables gives; a load that is written anew brings new ones with it, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowward.operators.aggregates import heat_grid, rated, upload_rate, week_slot
from flowward.operators.features import pack_features
from flowward.operators.joins import recent_complete
from flowward.operators.recent import top_recent
from flowward.operators.scoring import ACTION_COLUMNS, ATTACK_COLUMNS, THREAT_COLUMNS, attach_actions
from flowward.operators.sets import union_all
from flowward.profiles import THREAT, FeatureProfile

CELLS = (
    "kind string, hour timestamp, source string, batch_id string, label string, total bigint, attacks bigint, "
    "normal bigint, first_at timestamp, load_id string"
)
#: Newest predictions that are kept of each load.
KEPT = 100
PARTS = ("traffic", "threat", "attack", "action")


def newest_schema(schemas: dict[str, str]) -> str:
    """The columns of the newest predictions, from those of the four result tables in their order."""
    structs = [f"{part} struct<{ddl}>" for part, ddl in zip(PARTS, schemas.values(), strict=True)]
    return ", ".join(["created_at timestamp", "id bigint", "kind string", *structs, "load_id string"])


def _cells(rows: DataFrame, kind: str, keys: dict[str, Column], attacks: Column, normal: Column) -> DataFrame:
    keyed = {"hour": F.lit(None).cast("timestamp")} | {k: F.lit(None).cast("string") for k in ("source", "batch_id", "label")}
    keyed |= keys
    load = F.col("load_id") if "load_id" in rows.columns else F.lit(None).cast("string")
    counts = rows.groupBy(*[c.alias(k) for k, c in keyed.items()], load.alias("load_id")).agg(
        F.count("*").alias("total"),
        F.count(F.when(attacks, 1)).alias("attacks"),
        F.count(F.when(normal, 1)).alias("normal"),
        F.min("created_at").alias("first_at"),
    )
    return counts.select(F.lit(kind).alias("kind"), "hour", "source", "batch_id", "label", "total", "attacks", "normal", "first_at", "load_id")


def _hourly(rows: DataFrame, kind: str, label: str | None = None, attack: Column | None = None) -> DataFrame:
    keys = {"hour": F.date_trunc("hour", "created_at")} | ({"label": F.col(label)} if label else {})
    attack = F.lit(False) if attack is None else attack
    return _cells(rows, kind, keys, attack, ~attack)


def _batches(rows: DataFrame, attacks: Column, normal: Column) -> DataFrame:
    return _cells(rows, "batch", {"source": F.col("source"), "batch_id": F.col("batch_id")}, attacks, normal)


def load_cells(scored: DataFrame, profile: FeatureProfile) -> DataFrame:
    """The cells of a load's scored rows of one profile."""
    if profile.model_type == THREAT:
        flagged = F.coalesce("is_attack", F.lit(False))
        normal = F.col("is_attack").isNotNull() & ~flagged
        return _hourly(scored, "threat", attack=flagged).unionByName(_batches(scored, flagged, normal))
    attack = _hourly(scored, "attack", "attack_type_name")
    action = attach_actions(attack.withColumnRenamed("label", "attack_type_name"))
    keys = ["hour", "source", "batch_id", F.col("action_type").alias("label"), "load_id"]
    sums = [F.sum(c).alias(c) for c in ("total", "attacks", "normal")]
    action = action.groupBy(*keys).agg(*sums, F.min("first_at").alias("first_at")).withColumn("kind", F.lit("action"))
    # any row with an attack prediction counts as an attack, benign or not
    return union_all(attack, action, _batches(scored, F.lit(True), F.lit(False)))


def table_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """The cells of any result tables; a traffic row may have a threat and an attack prediction, both or none."""
    threat = tables["threat"].select(F.col("traffic_data_id").alias("_key"), "is_attack")
    attack = tables["attack"].select(F.col("traffic_data_id").alias("_key"), F.lit(True).alias("_attack"))
    rows = tables["traffic"].withColumnRenamed("id", "_key").drop("features").join(threat, "_key", "left").join(attack, "_key", "left")
    found, flagged = F.coalesce("_attack", F.lit(False)), F.coalesce("is_attack", F.lit(False))
    return union_all(
        _hourly(tables["threat"], "threat", attack=F.coalesce("is_attack", F.lit(False))),
        _hourly(tables["attack"], "attack", "attack_type_name"),
        _hourly(tables["action"], "action", "action_type"),
        _batches(rows, flagged | found, F.col("is_attack").isNotNull() & ~flagged & ~found),
    )


def load_newest(scored: DataFrame, profile: FeatureProfile, n: int = KEPT) -> DataFrame:
    """The ``n`` newest predictions of a load with all that belongs to them."""
    keys = F.broadcast(top_recent(scored.select("created_at", "id"), n))  # n rows at most; whole rows are not sorted
    rows = pack_features(scored.join(keys, ["created_at", "id"], "left_semi"), profile)
    base, at_end = [F.col("id"), F.col("id").alias("traffic_data_id"), F.col("created_at")], ["source", "load_id"]
    traffic = F.struct("id", "created_at", "features", "batch_id", *at_end)
    if profile.model_type == THREAT:
        parts = {"threat": F.struct(*base, *THREAT_COLUMNS, *at_end)}
    else:
        rows = attach_actions(rows)
        link = [F.col("id"), F.col("id").alias("attack_prediction_id"), F.col("created_at")]
        done = [F.lit("logged").alias("status"), F.col("created_at").alias("execution_time"), F.lit(None).cast("string").alias("error_message")]
        parts = {"attack": F.struct(*base, *ATTACK_COLUMNS, *at_end), "action": F.struct(*link, *ACTION_COLUMNS, *done, *at_end)}
    kind = F.lit("threat" if profile.model_type == THREAT else "attack").alias("kind")
    # a struct that rows of this type do not have is left out, and null when it is read
    return rows.select("created_at", "id", kind, traffic.alias("traffic"), *[c.alias(p) for p, c in parts.items()], "load_id")


def table_newest(tables: dict[str, DataFrame], n: int = KEPT) -> DataFrame:
    """The ``n`` newest threat predictions of any result tables."""
    rows = recent_complete(tables, n)
    return rows.select(F.col("threat.created_at").alias("created_at"), F.col("threat.id").alias("id"), F.lit("threat").alias("kind"), *PARTS)


# -- merged ------------------------------------------------------------------------


def _of(cells: DataFrame, kind: str) -> DataFrame:
    return cells.where(F.col("kind") == kind)


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def merged_threat_stats(cells: DataFrame) -> DataFrame:
    """As `aggregates.threat_stats`."""
    return rated(_of(cells, "threat").agg(_sum("total"), _sum("attacks")))


def merged_distribution(cells: DataFrame, kind: str) -> DataFrame:
    """As `aggregates.attack_distribution` (``attack``) and `aggregates.action_distribution` (``action``)."""
    name = {"attack": "attack_type_name", "action": "action_type"}[kind]
    return _of(cells, kind).groupBy(F.col("label").alias(name)).agg(F.sum("total").alias("count"))


def merged_batches(cells: DataFrame) -> DataFrame:
    """As `aggregates.list_batches`."""
    own = _of(cells, "batch").where((F.col("source") == "upload") & F.col("batch_id").isNotNull())
    counts = own.groupBy("batch_id").agg(F.sum("total").alias("row_count"), F.min("first_at").alias("uploaded_at"))
    return counts.orderBy(F.col("uploaded_at").desc(), F.col("batch_id"))


def merged_summary(cells: DataFrame, batch_id: str) -> DataFrame:
    """As `aggregates.upload_summary`."""
    own = _of(cells, "batch").where(F.col("batch_id") == batch_id)
    return upload_rate(own.agg(_sum("total"), _sum("attacks"), _sum("normal")))


def merged_heatmap(cells: DataFrame) -> DataFrame:
    """As `aggregates.attack_heatmap`; a session time zone of whole hours is taken for granted."""
    return heat_grid(_of(cells, "threat").groupBy(week_slot("hour")).agg(F.sum("attacks").alias("n")))


def merged_recent(newest: DataFrame, tables: dict[str, DataFrame], n: int = 20) -> DataFrame:
    """As `joins.recent_complete`; more rows than are kept of each load are looked up in the tables."""
    if n > KEPT:
        return recent_complete(tables, n)
    return top_recent(newest.where("kind = 'threat'"), n).select(*PARTS)


def merged_stats(parts: dict[str, DataFrame], tables: dict[str, DataFrame], n: int = 20) -> dict[str, DataFrame]:
    """As `aggregates.prediction_stats`."""
    return {
        "totals": merged_threat_stats(parts["cells"]),
        "distribution": merged_distribution(parts["cells"], "attack"),
        "recent": merged_recent(parts["newest"], tables, n),
    }
