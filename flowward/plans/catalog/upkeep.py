"""Change sets applied to the whitelist, the source configuration and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.operators import dimensions as D
from flowward.plans.catalog.dashboards import MODELS, registry
from flowward.plans.catalog.registry import query
from flowward.profiles import THREAT_CURRENT
from flowward.sources import flow_views as V

_ENTRIES = "SELECT c_custkey AS id, concat('10.1.', CAST(c_custkey // 256 % 256 AS VARCHAR), '.', CAST(c_custkey % 256 AS VARCHAR)) AS ip_address, c_name AS description, c_nationkey < 20 AS is_active FROM customer"


def entries(spark, sf_dir):
    """Customers as whitelist entries."""
    key = F.col("c_custkey")
    part = [(F.floor(key / 256) % 256).cast("string"), (key % 256).cast("string")]
    return V.read_table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(F.lit("10.1."), part[0], F.lit("."), part[1]).alias("ip_address"),
        F.col("c_name").alias("description"),
        (F.col("c_nationkey") < 20).alias("is_active"),
    )


_CHANGES = """SELECT o_custkey AS id, CASE WHEN max(o_orderstatus) = 'P' THEN concat('orders: ', CAST(count(*) AS VARCHAR)) END
    AS description, CASE WHEN min(o_orderstatus) = 'F' THEN FALSE END AS is_active FROM orders GROUP BY 1"""


@query(
    f"""SELECT coalesce(e.id, c.id) AS id, e.ip_address, coalesce(c.description, e.description) AS description,
    coalesce(c.is_active, e.is_active) AS is_active FROM ({_ENTRIES}) e FULL JOIN ({_CHANGES}) c ON c.id = e.id"""
)
def whitelist_upsert(spark, sf_dir):
    """Partial updates of entries: only the fields a change gives are replaced."""
    orders = V.read_table(spark, sf_dir, "orders")
    changes = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.when(F.max("o_orderstatus") == "P", F.concat(F.lit("orders: "), F.count("*").cast("string"))).alias("description"),
        F.when(F.min("o_orderstatus") == "F", F.lit(False)).alias("is_active"),
    )
    return D.upsert(entries(spark, sf_dir), changes, "id")


_FEW_ORDERS = "SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING count(*) < 10"


@query(f"SELECT * FROM ({_ENTRIES}) WHERE id NOT IN ({_FEW_ORDERS})")
def whitelist_delete(spark, sf_dir):
    """Entries left after deleting those of customers with few orders."""
    orders = V.read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).count()
    left, _ = D.delete_keys(entries(spark, sf_dir), orders.where("count < 10").select("id"))
    return left


@query(
    f"""SELECT DISTINCT id FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS id
    FROM orders) WHERE id NOT IN (SELECT id FROM ({_ENTRIES}))"""
)
def delete_keys_not_found(spark, sf_dir):
    """Asked-for keys that the table does not have."""
    key = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey"))
    keys = V.read_table(spark, sf_dir, "orders").select(key.alias("id"))
    _, unknown = D.delete_keys(entries(spark, sf_dir), keys)
    return unknown


_NEW_IPS = """SELECT event_id AS id, CASE event_type WHEN 'error' THEN concat('host', CAST(user_id AS VARCHAR))
    WHEN 'view' THEN concat('10.1.0.', CAST(user_id % 256 AS VARCHAR))
    ELSE concat('10.9.', CAST(user_id // 256 % 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) END AS ip_address,
    event_type = 'error' AS malformed FROM events"""


def new_ips(spark, sf_dir):
    """Events as requests to add an address: malformed, perhaps known, or new, many of them repeated."""
    user, kind = F.col("user_id"), F.col("event_type")
    low = (user % 256).cast("string")
    text = (
        F.when(kind == "error", F.concat(F.lit("host"), user.cast("string")))
        .when(kind == "view", F.concat(F.lit("10.1.0."), low))
        .otherwise(F.concat(F.lit("10.9."), (F.floor(user / 256) % 256).cast("string"), F.lit("."), low))
    )
    return V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("ip_address"))


_FRESH = f"""SELECT ip_address, min(id) AS id FROM ({_NEW_IPS}) WHERE NOT malformed
    AND ip_address NOT IN (SELECT ip_address FROM ({_ENTRIES})) GROUP BY 1"""


@query(
    f"""SELECT ip_address, id, is_active FROM ({_ENTRIES})
    UNION ALL SELECT ip_address, id, TRUE FROM ({_FRESH})"""
)
def whitelist_insert(spark, sf_dir):
    """The whitelist after adding the valid new addresses, the first request of each."""
    dim, _ = D.insert_ips(entries(spark, sf_dir), new_ips(spark, sf_dir))
    return dim.select("ip_address", "id", "is_active")


@query(
    f"""SELECT id, ip_address, 'Invalid IP address format' AS reason FROM ({_NEW_IPS}) WHERE malformed
    UNION ALL SELECT n.id, n.ip_address, 'IP address already exists in whitelist' FROM ({_NEW_IPS}) n
    WHERE NOT malformed AND NOT EXISTS (SELECT 1 FROM ({_FRESH}) f WHERE f.ip_address = n.ip_address AND f.id = n.id)"""
)
def whitelist_insert_rejects(spark, sf_dir):
    _, rejects = D.insert_ips(entries(spark, sf_dir), new_ips(spark, sf_dir))
    return rejects.select("id", "ip_address", "reason")


@query(
    f"""SELECT id, model_type, version, CASE WHEN t.last IS NULL THEN is_active ELSE id = t.last END AS is_active
    FROM ({MODELS}) m LEFT JOIN (SELECT m2.model_type AS mt, arg_max(r.l_suppkey, (r.at, r.l_suppkey)) AS last
        FROM (SELECT l_suppkey, max(l_shipdate) AS at FROM lineitem GROUP BY 1) r JOIN ({MODELS}) m2 ON m2.id = r.l_suppkey
        GROUP BY 1) t ON t.mt = m.model_type"""
)
def activations_applied(spark, sf_dir):
    """A log of activation requests applied: per model type only the last requested version is active."""
    requests = V.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.col("l_shipdate").alias("requested_at")
    )
    return D.activate_latest(registry(spark, sf_dir), requests).select("id", "model_type", "version", "is_active")


@query(
    f"""SELECT id, model_type, CASE WHEN model_type = (SELECT model_type FROM ({MODELS}) WHERE id = 3) THEN id = 3
    ELSE is_active END AS is_active FROM ({MODELS})"""
)
def single_activation(spark, sf_dir):
    return D.activate(registry(spark, sf_dir), 3).select("id", "model_type", "is_active")


@query(f"SELECT id, is_active AND id <> 4 AS is_active FROM ({MODELS})")
def single_deactivation(spark, sf_dir):
    return D.deactivate(registry(spark, sf_dir), 4).select("id", "is_active")


_OWN = f"""SELECT arg_min(version, id) AS version FROM ({MODELS}) WHERE model_type = 'threat_detector' AND is_active"""


@query(
    f"""SELECT 'threat_detector' AS model_type, version, {len(THREAT_CURRENT.features)} AS features, 'Normal,Attack' AS labels
    FROM ({_OWN})"""
)
def active_profile_with_default(spark, sf_dir):
    """The active model has no profile of its own, so the default of its type applies."""
    none = F.lit(None).cast("array<string>")
    models = registry(spark, sf_dir).withColumns({"expected_features": none, "class_labels": none})
    return D.active_profile(models, "threat_detector").select(
        "model_type",
        "version",
        F.size("expected_features").alias("features"),
        F.array_join("class_labels", ",").alias("labels"),
    )


def source_params(spark, sf_dir):
    """Suppliers as configured sources with two parameters each."""
    return V.read_table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("source_name"),
        (F.col("s_acctbal") > 0).alias("is_enabled"),
        F.create_map(
            F.lit("topic"), F.concat(F.lit("t-"), F.col("s_nationkey").cast("string")), F.lit("group"), F.lit("main")
        ).alias("config_params"),
    )


@query(
    """SELECT s_name AS source_name, CASE WHEN s_name = 'Supplier#000000007' THEN 'changed'
    ELSE concat('t-', CAST(s_nationkey AS VARCHAR)) END AS topic, 'main' AS "group", 2 AS params FROM supplier"""
)
def parameter_changed(spark, sf_dir):
    rows = D.set_param(source_params(spark, sf_dir), "Supplier#000000007", "topic", "changed")
    params = F.col("config_params")
    return rows.select(
        "source_name", params["topic"].alias("topic"), params["group"].alias("group"), F.size(params).alias("params")
    )


@query("SELECT s_name AS source_name, 'none' AS value FROM supplier WHERE s_name = 'Supplier#000000003'")
def parameter_with_default(spark, sf_dir):
    return D.get_param(source_params(spark, sf_dir), "Supplier#000000003", "interface", "none")


@query("SELECT s_name AS source_name FROM supplier WHERE s_acctbal > 0 ORDER BY 1")
def enabled_source_listing(spark, sf_dir):
    return D.enabled_sources(source_params(spark, sf_dir)).select("source_name")
