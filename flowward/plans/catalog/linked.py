"""Scores, the four linked tables, joins, listings and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.functions.labels import label_name, severity, short_name, version_string
from flowward.functions.rules import is_attack
from flowward.operators import aggregates as A
from flowward.operators import filters as FL
from flowward.operators import joins as J
from flowward.operators.dashboards import merged_recent
from flowward.operators import recent as R
from flowward.operators.reports import history_rows, log_lines
from flowward.operators.scoring import attach_actions
from flowward.operators.sets import union_all
from flowward.plans.catalog.frames import flatten_complete, live_messages
from flowward.plans.catalog.registry import query
from flowward.profiles import default_sources
from flowward.session import scratch_path
from flowward.sources import flow_views as V
from flowward.sources.bucketed import bucketed_complete, write_bucketed

COMPLETE_COLUMNS = (
    "id, source, batch_id, prediction_score, is_attack, attack_type_name, confidence, action_type"
)


@query("SELECT id, prediction_score, is_attack, threshold, model_version FROM threat")
def threat_scores(spark, sf_dir):
    t = V.scored_tables(spark, sf_dir)["threat"]
    return t.select("id", "prediction_score", "is_attack", "threshold", "model_version")


@query("SELECT id, attack_type_encoded, attack_type_name, confidence, model_version FROM attack")
def attack_classes(spark, sf_dir):
    t = V.scored_tables(spark, sf_dir)["attack"]
    return t.select("id", "attack_type_encoded", "attack_type_name", "confidence", "model_version")


@query(
    "SELECT id, attack_prediction_id, created_at, action_type, action_description, pkey AS param_name, "
    "pvalue AS param_value, status, execution_time FROM action"
)
def healing_actions(spark, sf_dir):
    t = V.scored_tables(spark, sf_dir)["action"]
    entry = F.get(F.map_entries("action_params"), F.lit(0))
    return t.select(
        "id",
        "attack_prediction_id",
        "created_at",
        "action_type",
        "action_description",
        entry["key"].alias("param_name"),
        entry["value"].alias("param_value"),
        "status",
        "execution_time",
    )


@query(
    """SELECT o.id, o.name AS attack_type_name, coalesce(d.action_type, 'log_only') AS action_type,
    coalesce(d.action_description, concat('No action defined for ', o.name)) AS action_description
    FROM (SELECT f.id, coalesce(l.label, 'Unknown') AS name FROM flow42 f
          LEFT JOIN labels14 l ON l.code = f.id % 17 - 1) o
    LEFT JOIN actions14 d ON d.label = o.name"""
)
def actions_with_unknown_types(spark, sf_dir):
    named = V.flow42(spark, sf_dir).select("id", label_name(F.col("id") % 17 - 1).alias("attack_type_name"))
    return attach_actions(named).select("id", "attack_type_name", "action_type", "action_description")


@query(
    """SELECT f.id, f.id % 17 - 1 AS code, coalesce(l.label, 'Unknown') AS attack_type_name FROM flow42 f
    LEFT JOIN labels14 l ON l.code = f.id % 17 - 1"""
)
def label_names(spark, sf_dir):
    code = F.col("id") % 17 - 1
    return V.flow42(spark, sf_dir).select("id", code.alias("code"), label_name(code).alias("attack_type_name"))


@query(
    """SELECT id, score, score > CAST(0.7 AS DOUBLE) AND NOT isnan(score) AS is_attack FROM (
    SELECT t.id, CASE WHEN e.event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE t.prediction_score END AS score
    FROM threat t JOIN events e ON e.event_id = t.id)"""
)
def strict_threshold(spark, sf_dir):
    """A higher threshold over scores of which some are NaN."""
    flows = V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    scored = V.result_tables(spark, sf_dir)["threat"].select("id", "prediction_score").join(flows, "id")
    score = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("prediction_score"))
    return scored.select("id", score.alias("score")).select("id", "score", is_attack(F.col("score"), 0.7).alias("is_attack"))


# -- joins -------------------------------------------------------------------


@query(f"SELECT {COMPLETE_COLUMNS} FROM complete")
def complete_predictions(spark, sf_dir):
    return flatten_complete(J.complete_predictions(**V.result_tables(spark, sf_dir)))


@query(f"SELECT {COMPLETE_COLUMNS} FROM complete")
def bucketed_complete_predictions(spark, sf_dir):
    """From a copy of the tables that is bucketed by traffic row."""
    path = scratch_path(spark, "bucketed")
    write_bucketed(V.result_tables(spark, sf_dir), path, 8)
    return flatten_complete(bucketed_complete(spark, path, 8))


_RECENT = f"SELECT {COMPLETE_COLUMNS} FROM complete ORDER BY threat_at DESC, threat_id DESC LIMIT 20"


@query(_RECENT)
def recent_complete(spark, sf_dir):
    """From the newest predictions that each load keeps."""
    return flatten_complete(merged_recent(V.dashboard_parts(spark, sf_dir)["newest"], V.result_tables(spark, sf_dir), 20))


@query(_RECENT)
def scanned_recent_complete(spark, sf_dir):
    return flatten_complete(J.recent_complete(V.result_tables(spark, sf_dir), 20))


@query(
    """SELECT t.id, t.source, p.prediction_score, a.attack_type_name FROM (
        SELECT traffic_data_id, max(created_at) AS latest, max(id) AS id FROM (
            SELECT * FROM (SELECT created_at, id, traffic_data_id FROM threat ORDER BY 1 DESC, 2 DESC LIMIT 1000)
            UNION ALL SELECT * FROM (SELECT created_at, id, traffic_data_id FROM attack ORDER BY 1 DESC, 2 DESC LIMIT 1000)
        ) GROUP BY traffic_data_id ORDER BY latest DESC, id DESC LIMIT 1000) k
    JOIN traffic t ON t.id = k.traffic_data_id LEFT JOIN threat p ON p.traffic_data_id = t.id
    LEFT JOIN attack a ON a.traffic_data_id = t.id"""
)
def recent_complete_with_attack_rows(spark, sf_dir):
    rows = flatten_complete(J.recent_complete(V.result_tables(spark, sf_dir), 1000, include_attack_rows=True))
    return rows.select("id", "source", "prediction_score", "attack_type_name")


@query(f"SELECT {COMPLETE_COLUMNS} FROM complete WHERE batch_id = 'batch-6'")
def batch_complete(spark, sf_dir):
    return flatten_complete(J.batch_complete(V.result_tables(spark, sf_dir), "batch-6"))


@query(
    """SELECT a.id, a.attack_type_name, x.id AS action_id, x.action_type, x.action_description, x.status
    FROM attack a LEFT JOIN action x ON x.attack_prediction_id = a.id"""
)
def attacks_with_recorded_actions(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)
    rows = J.join_actions(t["attack"], t["action"])
    return rows.select("id", "attack_type_name", "action_id", "action_type", "action_description", "status")


@query(
    """SELECT m.id, m.sender_ip, EXISTS (SELECT 1 FROM whitelist w WHERE w.is_active AND w.ip_address = m.sender_ip)
    AS admitted FROM messages m"""
)
def whitelist_admission(spark, sf_dir):
    rows = J.admitted_flag(V.messages(spark, sf_dir), V.whitelist(spark, sf_dir))
    return rows.select("id", "sender_ip", "admitted")


@query(
    """SELECT m.id, m.sender_ip, EXISTS (SELECT 1 FROM whitelist w WHERE w.is_active AND w.ip_address = m.sender_ip)
    AS admitted FROM messages m"""
)
def filtered_whitelist_admission(spark, sf_dir):
    """By a Bloom filter of the whitelist before the exact join."""
    rows = J.admitted_flag(V.messages(spark, sf_dir), V.whitelist(spark, sf_dir), prefilter=True)
    return rows.select("id", "sender_ip", "admitted")


@query(
    "SELECT id, sender_ip, source FROM messages WHERE sender_ip NOT IN (SELECT ip_address FROM whitelist WHERE is_active)"
)
def rejected_messages(spark, sf_dir):
    _, rejected = J.admit(V.messages(spark, sf_dir), V.whitelist(spark, sf_dir))
    return rejected.select("id", "sender_ip", "source")


SOURCE_CONFIG = """SELECT DISTINCT CASE WHEN source = 'realtime' THEN 'packet_capture' ELSE source END AS source_name,
    source = 'external_kafka' AS is_enabled FROM messages"""


def source_config(spark, sf_dir):
    """Of the three message sources one is enabled, one disabled and one goes by another name and so is not configured."""
    source = F.col("source")
    name = F.when(source == "realtime", "packet_capture").otherwise(source)
    return V.messages(spark, sf_dir).select(name.alias("source_name"), (source == "external_kafka").alias("is_enabled")).distinct()


@query(
    f"""SELECT id, source, batch_id FROM messages
    WHERE source IN (SELECT source_name FROM ({SOURCE_CONFIG}) WHERE is_enabled)"""
)
def gated_messages(spark, sf_dir):
    return J.gate_sources(V.messages(spark, sf_dir), source_config(spark, sf_dir)).select("id", "source", "batch_id")


@query(
    f"""SELECT source_name, is_enabled FROM ({SOURCE_CONFIG}) UNION ALL
    SELECT * FROM (VALUES ('internal_kafka', TRUE)) t(source_name, is_enabled)"""
)
def default_sources_added(spark, sf_dir):
    config = source_config(spark, sf_dir)
    defaults = default_sources(spark).select("source_name", "is_enabled")
    return J.insert_missing(config, defaults, "source_name")


# -- listings ---------------------------------------------------------------------


@query("SELECT id, created_at, prediction_score, is_attack FROM threat ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_threats(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return R.recent_threats(t).select("id", "created_at", "prediction_score", "is_attack")


@query(
    """SELECT id, created_at, prediction_score FROM
    (SELECT * FROM threat ORDER BY created_at DESC, id DESC LIMIT 100) WHERE is_attack"""
)
def recent_threats_attacks_only(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return R.recent_threats(t, attacks_only=True).select("id", "created_at", "prediction_score")


@query("SELECT id, created_at, prediction_score FROM threat WHERE is_attack ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_attacking_threats(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return R.recent_threats(t, attacks_only=True, filter_first=True).select("id", "created_at", "prediction_score")


@query("SELECT id, created_at, attack_type_name, confidence FROM attack ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_attacks(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["attack"]
    return R.recent_attacks(t).select("id", "created_at", "attack_type_name", "confidence")


@query(
    """SELECT id, created_at, attack_type_name FROM (SELECT * FROM attack ORDER BY created_at DESC, id DESC LIMIT 1000)
    WHERE attack_type_name = 'DDoS'"""
)
def recent_attacks_of_type(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["attack"]
    return R.recent_attacks(t, 1000, "DDoS").select("id", "created_at", "attack_type_name")


@query(
    """SELECT id, created_at, attack_type_name FROM attack WHERE attack_type_name = 'Infiltration'
    ORDER BY created_at DESC, id DESC LIMIT 100"""
)
def recent_infiltrations(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["attack"]
    rows = R.recent_attacks(t, 100, "Infiltration", filter_first=True)
    return rows.select("id", "created_at", "attack_type_name")


@query("SELECT id, created_at, action_type, action_description FROM action ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_actions(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["action"]
    return R.recent_actions(t).select("id", "created_at", "action_type", "action_description")


@query(
    """SELECT id, created_at, action_description FROM (SELECT * FROM action ORDER BY created_at DESC, id DESC LIMIT 500)
    WHERE action_type = 'block_ip'"""
)
def recent_actions_of_type(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["action"]
    return R.recent_actions(t, 500, "block_ip").select("id", "created_at", "action_description")


@query(
    """SELECT threat_id AS id, threat_at AS created_at, coalesce(attack_type_name, 'Unknown') AS attack_type,
    coalesce(confidence, prediction_score) AS confidence, prediction_score AS threat_score,
    CASE WHEN prediction_score >= CAST(0.9 AS DOUBLE) THEN 'critical' WHEN prediction_score >= CAST(0.7 AS DOUBLE)
    THEN 'high' WHEN prediction_score >= CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT * FROM complete ORDER BY threat_at DESC, threat_id DESC LIMIT 20) WHERE is_attack
    ORDER BY threat_at DESC, threat_id DESC LIMIT 10"""
)
def threat_table(spark, sf_dir):
    return R.threat_table(J.recent_complete(V.result_tables(spark, sf_dir), 20))


@query(
    """SELECT CASE WHEN prediction_score >= CAST(0.9 AS DOUBLE) THEN 'critical'
    WHEN prediction_score >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN prediction_score >= CAST(0.5 AS DOUBLE)
    THEN 'medium' ELSE 'low' END AS severity, count(*) AS "count" FROM threat GROUP BY 1"""
)
def severity_counts(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return t.groupBy(severity(F.col("prediction_score")).alias("severity")).agg(F.count("*").alias("count"))


@query(
    """SELECT CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS "index", id, created_at,
    prediction_score AS score, threshold, is_attack FROM threat ORDER BY created_at DESC, id DESC LIMIT 100"""
)
def score_series(spark, sf_dir):
    return R.score_series(V.result_tables(spark, sf_dir)["threat"], 100)


@query(
    """SELECT id, created_at, CASE WHEN action_description IS NOT NULL THEN 'action' WHEN is_attack THEN 'attack'
    ELSE 'normal' END AS type, CASE WHEN action_description IS NOT NULL THEN action_description
    WHEN is_attack THEN concat('Attack detected from traffic_id ', CAST(traffic_data_id AS VARCHAR))
    ELSE concat('Normal traffic analyzed - traffic_id ', CAST(traffic_data_id AS VARCHAR)) END AS message,
    prediction_score AS score FROM live ORDER BY created_at DESC, id DESC LIMIT 50"""
)
def log_lines_latest(spark, sf_dir):
    return log_lines(live_messages(spark, sf_dir)).select("id", "created_at", "type", "message", "score")


@query(
    """SELECT id, threat_at AS created_at, printf('%.3f', prediction_score) AS score,
    CASE WHEN is_attack THEN 'Attack' ELSE 'Normal' END AS status, coalesce(attack_type_name, '-') AS attack_type,
    coalesce(printf('%.1f%%', confidence * 100), '-') AS confidence
    FROM complete ORDER BY threat_at DESC, threat_id DESC LIMIT 1000"""
)
def prediction_history(spark, sf_dir):
    return history_rows(J.recent_complete(V.result_tables(spark, sf_dir), 1000))


@query(
    """SELECT attack_type_name, CASE WHEN length(attack_type_name) > 20 THEN concat(substr(attack_type_name, 1, 20), '...')
    ELSE attack_type_name END AS short_name, count(*) AS "count" FROM attack GROUP BY 1, 2"""
)
def short_names(spark, sf_dir):
    dist = A.attack_distribution(V.result_tables(spark, sf_dir)["attack"])
    return dist.select("attack_type_name", short_name(F.col("attack_type_name")).alias("short_name"), "count")


@query("SELECT event_id AS id, strftime(ts, '%Y%m%d_%H%M%S') AS version FROM events")
def version_strings(spark, sf_dir):
    events = V.read_table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), version_string(F.col("ts")).alias("version"))


# -- filters ----------------------------------------------------------------------


@query("SELECT id, created_at, batch_id FROM traffic WHERE source = 'upload' AND batch_id IS NOT NULL")
def upload_rows(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["traffic"]
    return FL.upload_batches(t).select("id", "created_at", "batch_id")


@query("SELECT id, created_at, source FROM traffic WHERE batch_id = 'batch-12'")
def rows_of_batch(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["traffic"]
    return FL.batch_rows(t, "batch-12").select("id", "created_at", "source")


@query("SELECT id, prediction_score, is_attack FROM threat WHERE traffic_data_id = 123")
def threat_of_traffic_row(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return FL.lookup(t, "traffic_data_id", 123).select("id", "prediction_score", "is_attack")


@query("SELECT ip_address FROM whitelist WHERE is_active")
def active_whitelist(spark, sf_dir):
    return FL.active_only(V.whitelist(spark, sf_dir)).select("ip_address")


@query(
    """SELECT id, created_at FROM threat
    WHERE created_at > (SELECT max(created_at) FROM threat) - INTERVAL 1 SECOND"""
)
def last_second_threats(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"].select("id", "created_at")
    now = t.agg(F.max("created_at")).scalar()
    return FL.last_second(t, now)


@query(
    """SELECT id, created_at, 'threat' AS kind, src_bytes, CAST(NULL AS DOUBLE) AS flow_duration FROM flow10
    UNION ALL SELECT id, created_at, 'attack', NULL, flow_duration FROM flow42"""
)
def union_of_sources(spark, sf_dir):
    threats = V.flow10(spark, sf_dir).select("id", "created_at", F.lit("threat").alias("kind"), "src_bytes")
    attacks = V.flow42(spark, sf_dir).select("id", "created_at", F.lit("attack").alias("kind"), "flow_duration")
    return union_all(threats, attacks)


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
)
def latest_order_per_customer(spark, sf_dir):
    orders = V.read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest_per(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("SELECT ip_address, is_active FROM whitelist ORDER BY ip_address")
def whitelist_listing(spark, sf_dir):
    return R.list_dim(V.whitelist(spark, sf_dir), "ip_address", "is_active")


@query('SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS "index" FROM flow10')
def event_sequence(spark, sf_dir):
    """Position of every row in time, over the whole table."""
    return R.with_sequence(V.flow10(spark, sf_dir).select("id", "created_at"), ["created_at", "id"])


@query(
    """SELECT day, attacks, CAST(sum(attacks) OVER (ORDER BY day) AS BIGINT) AS cum_attacks FROM
    (SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (is_attack) AS attacks FROM threat GROUP BY 1)"""
)
def cumulative_attacks(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    per_day = t.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.when(F.col("is_attack"), 1)).alias("attacks"))
    return R.cumulative(per_day, ["day"], ["attacks"])


@query(
    """SELECT day, n, (n - lag(n) OVER (ORDER BY day)) * CAST(100 AS DOUBLE) / lag(n) OVER (ORDER BY day) AS trend
    FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM threat GROUP BY 1)"""
)
def daily_trend(spark, sf_dir):
    t = V.result_tables(spark, sf_dir)["threat"]
    return R.pct_change(t.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")), "day", "n")


@query(
    """SELECT event_id, (value - lag(value) OVER o) * CAST(100 AS DOUBLE) / nullif(lag(value) OVER o, 0) AS trend
    FROM events WINDOW o AS (ORDER BY ts, event_id)"""
)
def value_trend(spark, sf_dir):
    """The change from each event to the next one in time, over the whole table."""
    events = V.read_table(spark, sf_dir, "events").select("event_id", "value", F.struct("ts", "event_id").alias("at"))
    return R.pct_change(events, "at", "value").select("event_id", "trend")


@query("SELECT event_id, user_id, event_type, value FROM events")
def shuffled_events(spark, sf_dir):
    """All rows in an order fixed by the seed."""
    events = V.read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.shuffle_rows(events, 42)
