"""Joins over the four linked result tables and lookups against dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowward.operators.membership import by_filter
from flowward.operators.recent import top_recent
from flowward.profiles import ATTACK, THREAT

# At most so many keys are fetched to the driver as a list of values.
LISTED = 1000


def _nest(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) with the whole row as one struct."""
    return df.select(F.col(key).alias("_key"), F.struct(*df.columns).alias(name))


def _attack_with_action(attack: DataFrame, action: DataFrame) -> DataFrame:
    """One row per attack prediction with its action.

    The action is joined before the attack meets the traffic rows: most of those
    have no attack, and their null keys would all land in one partition.
    """
    return (
        attack.select(
            F.col("traffic_data_id").alias("_traffic"),
            F.col("id").alias("_key"),
            F.struct(*attack.columns).alias("attack"),
        )
        .join(_nest(action, "attack_prediction_id", "action"), "_key", "left")
        .select(F.col("_traffic").alias("_key"), "attack", "action")
    )


def composite_parts(traffic: DataFrame, threat: DataFrame, attack: DataFrame, action: DataFrame) -> dict[str, DataFrame]:
    """What composite rows are joined from, each by ``_key``, the traffic row's id."""
    return {
        "traffic": _nest(traffic, "id", "traffic"),
        "threat": _nest(threat, "traffic_data_id", "threat"),
        "attack": _attack_with_action(attack, action),
    }


def composed(traffic: DataFrame, threat: DataFrame, attack: DataFrame) -> DataFrame:
    """{traffic, threat?, attack?, action?} from `composite_parts`."""
    joined = traffic.join(threat, "_key", "left").join(attack, "_key", "left")
    return joined.select("traffic", "threat", "attack", "action")


def complete_predictions(traffic: DataFrame, threat: DataFrame, attack: DataFrame, action: DataFrame) -> DataFrame:
    """{traffic, threat?, attack?, action?} per traffic row; every key is unique, so no group is larger than one."""
    return composed(**composite_parts(traffic, threat, attack, action))


def recent_complete(tables: dict[str, DataFrame], n: int = 20, include_attack_rows: bool = False) -> DataFrame:
    """The composite rows of the ``n`` newest predictions.

    Newest threat predictions by default; ``include_attack_rows`` also ranks
    traffic that only has an attack prediction. The chosen keys of all tables are
    fetched first, ``LISTED`` of them at most, and are filters that reach the scans;
    more keys than that are joined.
    """
    ranked = tables["threat"].select("created_at", "id", "traffic_data_id")
    if include_attack_rows:
        only_attack = tables["attack"].select("created_at", "id", "traffic_data_id")
        ranked = (
            top_recent(ranked, n)
            .unionByName(top_recent(only_attack, n))
            .groupBy("traffic_data_id")
            .agg(F.max("created_at").alias("created_at"), F.max("id").alias("id"))
        )
    keys = top_recent(ranked, n).select(F.col("traffic_data_id").alias("_chosen"))
    chosen = _among(keys, n)
    attack = chosen(tables["attack"], "traffic_data_id")
    attacks_chosen = _among(attack.select(F.col("id").alias("_chosen")), n)
    return complete_predictions(
        chosen(tables["traffic"], "id"),
        chosen(tables["threat"], "traffic_data_id"),
        attack,
        attacks_chosen(tables["action"], "attack_prediction_id"),
    )


def _among(keys: DataFrame, n: int):
    """A filter on the values of ``_chosen``: a list of values if there are few, else a join."""
    if n <= LISTED:
        found = [r[0] for r in keys.limit(LISTED + 1).collect() if r[0] is not None]
        if len(found) <= LISTED:
            return lambda df, key: df.where(df[key].isin(found))
    return lambda df, key: df.join(keys, df[key] == F.col("_chosen"), "left_semi")


def tables_of_batch(tables: dict[str, DataFrame], batch_id: str) -> dict[str, DataFrame]:
    """The result tables cut down to one upload batch.

    An upload's loads have its batch id in their names, so by their statistics only that batch's files are
    read. Tables without load ids are only filtered on the traffic side.
    """
    loads = [upload_load(batch_id, kind) for kind in (THREAT, ATTACK)]
    own = {
        name: df.where(F.col("load_id").isin(loads)) if "load_id" in df.columns else df for name, df in tables.items()
    }
    return own | {"traffic": own["traffic"].where(F.col("batch_id") == batch_id)}


def upload_load(batch_id: str, model_type: str | None = None) -> str:
    """The load id of an upload; a type of records that it may have is part of the stored one."""
    return f"upload-{batch_id}" + (f"-{model_type}" if model_type else "")


def batch_complete(tables: dict[str, DataFrame], batch_id: str) -> DataFrame:
    """The composite rows of one upload batch."""
    return complete_predictions(**tables_of_batch(tables, batch_id))


def join_actions(attacks: DataFrame, actions: DataFrame) -> DataFrame:
    """Attack predictions with the action recorded for each (left)."""
    wanted = actions.select(
        F.col("attack_prediction_id"),
        F.col("id").alias("action_id"),
        "action_type",
        "action_description",
        "action_params",
        "status",
    )
    return attacks.join(wanted, attacks["id"] == wanted["attack_prediction_id"], "left").drop("attack_prediction_id")


def dim_lookup(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", salts: int = 1) -> DataFrame:
    """Join facts to a dimension whose size is not known in advance.

    Spark broadcasts a dimension of few bytes and splits skewed partitions of a larger one as it
    finds them. With ``salts`` the join is on (key, salt), each row of the dimension once per salt, so
    that a key holding a large share of the facts is spread over as many tasks. The salt is a hash of
    the row and its partition: equal rows spread, and a re-run task salts as before.
    """
    if salts <= 1:
        return facts.join(dim, key, how)
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = [c for c, t in facts.dtypes if "map<" not in t and "variant" not in t]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(salts)).cast("int"))
    return salted.join(salted_dim, [key, "_salt"], how).drop("_salt")


def admitted_flag(messages: DataFrame, whitelist: DataFrame, prefilter: bool = False) -> DataFrame:
    """Add ``admitted``: whether the sender is an active whitelist entry (exact text, null never).

    With ``prefilter``, for a whitelist too large to broadcast, only messages that pass a Bloom filter of it are
    shuffled to the exact join; all others are settled where they are.
    """
    allowed = whitelist.where("is_active").select(F.col("ip_address").alias("sender_ip")).distinct()
    if not prefilter:
        return _exact_flag(messages, allowed)
    maybe, absent = by_filter(messages, allowed, "sender_ip")
    return _exact_flag(maybe, allowed).unionByName(absent.withColumn("admitted", F.lit(False)))


def _exact_flag(messages: DataFrame, allowed: DataFrame) -> DataFrame:
    joined = dim_lookup(messages, allowed.withColumn("_hit", F.lit(True)), "sender_ip")
    return joined.select(*messages.columns, F.coalesce("_hit", F.lit(False)).alias("admitted"))


def admit(messages: DataFrame, whitelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages from active whitelist entries, and all others."""
    flagged = admitted_flag(messages, whitelist)
    return flagged.where("admitted").drop("admitted"), flagged.where(~F.col("admitted")).drop("admitted")


def gate_sources(messages: DataFrame, config: DataFrame) -> DataFrame:
    """Messages of enabled sources; a disabled or unknown source yields nothing."""
    enabled = config.where("is_enabled").select(F.col("source_name").alias("source")).distinct()
    return dim_lookup(messages, enabled, "source", "left_semi").select(*messages.columns)


def insert_missing(dim: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The dimension with those new rows whose key it lacks."""
    added = new.join(dim.select(key), key, "left_anti")
    return dim.unionByName(added, allowMissingColumns=True)
