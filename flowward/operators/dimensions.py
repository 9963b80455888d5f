"""Maintenance of the dimension tables as batched change sets.

Every function returns the new table; `sources.tables.write_dim` stores it as a
new version, so readers of the old version are not disturbed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowward.functions.ips import is_valid_ip
from flowward.operators.joins import insert_missing
from flowward.operators.recent import latest_per
from flowward.profiles import ATTACK, ATTACK_PROFILE, THREAT_CURRENT, default_sources


class DimensionError(ValueError):
    """A change that the table does not allow."""


def upsert(dim: DataFrame, changes: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """Apply partial updates: a null in a change keeps the old value, an unknown key adds a row.

    ``changes`` has at most one row per key. ``updated_at`` is set where the dimension has it.
    """
    new = changes.withColumn("_changed", F.lit(True))
    old, chg = dim.alias("o"), new.alias("c")
    joined = old.join(chg, F.col(f"o.{key}") == F.col(f"c.{key}"), "full_outer")

    def merged(c: str) -> Column:
        if c == "updated_at" and "updated_at" not in changes.columns:
            stamp = F.current_timestamp() if now is None else now
            return F.when(F.col("c._changed"), stamp).otherwise(F.col("o.updated_at"))
        if c not in changes.columns:
            return F.col(f"o.{c}")
        return F.coalesce(F.col(f"c.{c}"), F.col(f"o.{c}"))

    return joined.select(*[merged(c).alias(c) for c in dim.columns])


def delete_keys(dim: DataFrame, keys: DataFrame, key: str = "id", guard: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table without the given keys, and the keys that were not found.

    Rows that satisfy ``guard`` (e.g. an active model) must not go: if one is asked for, nothing is deleted.
    """
    wanted = keys.select(key).distinct()
    if guard is not None:
        refused = dim.where(guard).join(wanted, key, "left_semi").select(key).limit(1).collect()
        if refused:
            raise DimensionError(f"Row {refused[0][0]} is in use and cannot be deleted")
    return dim.join(wanted, key, "left_anti"), wanted.join(dim.select(key), key, "left_anti")


def insert_ips(dim: DataFrame, new: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Add addresses to the whitelist; returns the new whitelist and the rejected rows with a reason.

    Rejected are malformed addresses, those already listed, and all but the first
    (least ``order``) of equal ones in the change set. The first of each is an
    aggregate, so many copies of one address are reduced before the shuffle.
    """
    valid = new.where(is_valid_ip(F.col("ip_address")))
    first = valid.groupBy("ip_address").agg(F.min(order).alias("_first"))
    known = dim.select("ip_address", F.lit(True).alias("_known")).distinct()
    status = first.join(known, "ip_address", "left")
    fresh = status.where(F.col("_known").isNull()).select("ip_address", F.col("_first").alias(order))
    # Equality on both keys spreads the copies of one address over all tasks.
    accepted = new.join(fresh, ["ip_address", order], "left_semi")
    added = accepted if "is_active" in new.columns else accepted.withColumn("is_active", F.lit(True))
    malformed = new.where(~F.coalesce(is_valid_ip(F.col("ip_address")), F.lit(False))).withColumn(
        "reason", F.lit("Invalid IP address format")
    )
    repeated = valid.join(fresh, ["ip_address", order], "left_anti").withColumn(
        "reason", F.lit("IP address already exists in whitelist")
    )
    return dim.unionByName(added, allowMissingColumns=True), malformed.unionByName(repeated)


def activate(models: DataFrame, model_id: int) -> DataFrame:
    """Make one model the only active one of its type."""
    target = models.where(F.col("id") == model_id).select("model_type").first()
    if target is None:
        raise DimensionError(f"Model with ID {model_id} not found")
    same_type = F.col("model_type") == F.lit(target["model_type"])
    return models.withColumn("is_active", F.when(same_type, F.col("id") == model_id).otherwise(F.col("is_active")))


def activate_latest(models: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply a log of activation requests (model_id, requested_at): per type the last one wins.

    Types without a request keep their state.
    """
    asked = requests.join(models.select(F.col("id").alias("model_id"), "model_type"), "model_id")
    last = latest_per(asked, "model_type", ["requested_at", "model_id"]).select(
        "model_type", F.col("model_id").alias("_active")
    )
    return models.join(last, "model_type", "left").select(
        *[c for c in models.columns if c != "is_active"],
        F.when(F.col("_active").isNotNull(), F.col("id") == F.col("_active")).otherwise(F.col("is_active")).alias("is_active"),
    )


def deactivate(models: DataFrame, model_id: int) -> DataFrame:
    """Switch one model off."""
    if models.where(F.col("id") == model_id).isEmpty():
        raise DimensionError(f"Model with ID {model_id} not found")
    return models.withColumn("is_active", F.col("is_active") & (F.col("id") != model_id))


def active_profile(models: DataFrame, model_type: str) -> DataFrame:
    """One row with the active model's features and labels, else the default ones of the type."""
    default = ATTACK_PROFILE if model_type in ("attack_classifier", ATTACK) else THREAT_CURRENT
    active = models.where((F.col("model_type") == model_type) & F.col("is_active")).orderBy("id").limit(1)
    wanted = models.sparkSession.range(1).select(F.lit(model_type).alias("model_type"))
    features = F.array(*[F.lit(f) for f in default.features])
    labels = F.array(*[F.lit(x) for x in default.class_labels])
    own = F.col("expected_features").isNotNull()
    return wanted.join(active.select("model_type", "version", "expected_features", "class_labels"), "model_type", "left").select(
        "model_type",
        "version",
        F.coalesce("expected_features", features).alias("expected_features"),
        F.when(own, F.col("class_labels")).otherwise(labels).alias("class_labels"),
    )


def get_param(config: DataFrame, source: str, param: str, default: str | None = None) -> DataFrame:
    """One row with a source's parameter value, the default when it has none."""
    return config.where(F.col("source_name") == source).select(
        "source_name", F.coalesce(F.col("config_params")[param], F.lit(default)).alias("value")
    )


def set_param(config: DataFrame, source: str, param: str, value: str) -> DataFrame:
    """Set one parameter of one source; its other parameters stay."""
    others = F.map_filter(F.coalesce("config_params", F.create_map().cast("map<string,string>")), lambda k, _: k != param)
    changed = F.map_concat(others, F.create_map(F.lit(param), F.lit(value)))
    return config.withColumn(
        "config_params", F.when(F.col("source_name") == source, changed).otherwise(F.col("config_params"))
    )


def enabled_sources(config: DataFrame) -> DataFrame:
    """Enabled sources by name."""
    return config.where("is_enabled").orderBy("source_name")


def ensure_defaults(config: DataFrame) -> DataFrame:
    """Add the seed sources that are missing."""
    return insert_missing(config, default_sources(config.sparkSession), "source_name")


def lookup_many(dim: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows with one of the given key values (by id, by name)."""
    return dim.where(F.col(key).isin(list(values)))
