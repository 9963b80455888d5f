"""The test tables seen as network-flow data.

Each view is a column -> SQL expression mapping that Spark and ANSI SQL engines
read alike, so the same text serves as the starting point of a check in another
engine. ``floor`` stands where a double becomes a whole number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.dashboards import table_cells, table_newest
from flowward.operators.features import pack_features
from flowward.operators.scoring import action_rows, rule_attack_class, rule_threat_score
from flowward.profiles import ATTACK_PROFILE, THREAT_LEGACY
from flowward.session import shared_dir


def _cycle(key: str, step: int, size: int) -> str:
    return f"CAST(({key} * {step}) % {size} AS DOUBLE)"


# Both threat profiles over `events`.
FLOW10 = {
    "id": "event_id",
    "created_at": "CAST(ts AS TIMESTAMP)",
    "service": "CAST(user_id % 70 AS DOUBLE)",
    "flag": "CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
    "WHEN 'signup' THEN 3 ELSE 4 END AS DOUBLE)",
    "src_bytes": "CAST(floor(value * 100) AS DOUBLE)",
    "dst_bytes": "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 120",
    "count": _cycle("event_id", 7, 512),
    "same_srv_rate": "CAST(event_id % 101 AS DOUBLE) / 100",
    "diff_srv_rate": "CAST(user_id % 101 AS DOUBLE) / 100",
    "dst_host_srv_count": _cycle("event_id", 13, 256),
    "dst_host_same_srv_rate": _cycle("event_id", 17, 101) + " / 100",
    "dst_host_same_src_port_rate": _cycle("event_id", 19, 101) + " / 100",
    "dst_host_diff_srv_rate": _cycle("event_id", 23, 101) + " / 100",
    "dst_host_srv_diff_host_rate": _cycle("event_id", 29, 101) + " / 100",
}

# The attack profile over `orders`.
FLOW42 = {
    "id": "o_orderkey",
    "created_at": "CAST(o_orderdate AS TIMESTAMP)",
    "destination_port": "CAST(CASE o_orderkey % 10 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 80 WHEN 3 THEN 443 "
    "WHEN 4 THEN 8080 WHEN 5 THEN 3306 WHEN 6 THEN 53 WHEN 7 THEN 25 WHEN 8 THEN 110 ELSE 143 END AS DOUBLE)",
    "flow_duration": _cycle("o_orderkey", 3701, 200000),
    "total_fwd_packets": _cycle("o_custkey", 7, 200),
    "total_length_of_fwd_packets": _cycle("o_custkey", 1, 9000),
    "fwd_packet_length_max": _cycle("o_orderkey", 3, 1461),
    "fwd_packet_length_min": _cycle("o_custkey", 5, 67),
    "bwd_packet_length_max": _cycle("o_orderkey", 7, 1399),
    "bwd_packet_length_min": _cycle("o_custkey", 11, 71),
    "flow_bytes_per_s": "CAST(floor(o_totalprice) AS DOUBLE)",
    "flow_packets_per_s": "CAST((o_custkey * 31 + o_orderkey) % 1500 AS DOUBLE)",
    "flow_iat_mean": _cycle("o_orderkey", 1, 997),
    "flow_iat_std": _cycle("o_orderkey", 1, 499),
    "flow_iat_min": _cycle("o_orderkey", 13, 23),
    "bwd_iat_total": _cycle("o_custkey", 17, 907),
    "bwd_iat_std": _cycle("o_orderkey", 19, 83),
    "fwd_psh_flags": _cycle("o_custkey", 23, 2),
    "bwd_psh_flags": _cycle("o_orderkey", 29, 2),
    "fwd_urg_flags": _cycle("o_custkey", 31, 2),
    "bwd_urg_flags": _cycle("o_orderkey", 37, 2),
    "fwd_header_length": _cycle("o_custkey", 41, 401),
    "bwd_header_length": _cycle("o_orderkey", 43, 389),
    "bwd_packets_per_s": _cycle("o_custkey", 1, 97),
    "min_packet_length": _cycle("o_custkey", 47, 65),
    "fin_flag_count": _cycle("o_orderkey", 1, 3),
    "rst_flag_count": _cycle("o_custkey", 1, 4),
    "psh_flag_count": "CAST((o_orderkey * 3 + o_custkey) % 3 AS DOUBLE)",
    "ack_flag_count": _cycle("o_custkey", 1, 51),
    "urg_flag_count": _cycle("o_orderkey", 53, 2),
    "down_up_ratio": _cycle("o_orderkey", 1, 5) + " / 2",
    "fwd_avg_bytes_per_bulk": _cycle("o_custkey", 59, 311),
    "fwd_avg_packets_per_bulk": _cycle("o_orderkey", 61, 13),
    "fwd_avg_bulk_rate": _cycle("o_custkey", 67, 221),
    "bwd_avg_bytes_per_bulk": _cycle("o_orderkey", 71, 307),
    "bwd_avg_packets_per_bulk": _cycle("o_custkey", 73, 14),
    "bwd_avg_bulk_rate": _cycle("o_orderkey", 79, 241),
    "init_win_bytes_forward": _cycle("o_custkey", 83, 65521),
    "init_win_bytes_backward": _cycle("o_orderkey", 89, 65519),
    "min_seg_size_forward": _cycle("o_custkey", 97, 33),
    "active_mean": _cycle("o_orderkey", 101, 181),
    "active_std": _cycle("o_custkey", 103, 61),
    "active_max": _cycle("o_orderkey", 107, 409),
    "idle_std": _cycle("o_custkey", 109, 43),
}

# Messages with sender, source and batch, and the whitelist, over `events`.
MESSAGES = {
    "id": "event_id",
    "sender_ip": "concat('10.0.0.', CAST(user_id % 256 AS STRING))",
    "source": "CASE event_id % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'realtime' ELSE 'external_kafka' END",
    "batch_id": "CASE WHEN event_id % 3 = 0 THEN concat('batch-', CAST(event_id % 20 AS STRING)) END",
}
WHITELIST = {
    "ip_address": "concat('10.0.0.', CAST(user_id % 256 AS STRING))",
    "is_active": "user_id % 256 % 3 = 0",
}


def select_sql(view: dict[str, str], table: str) -> str:
    """A view as a SELECT statement."""
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in view.items())} FROM {table}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_view(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in view.items()])


def in_pieces(df: DataFrame, key: str) -> DataFrame:
    """A test table, which comes as one piece, in one per core."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_pieces(read_table(spark, sf_dir, "events"), "event_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_pieces(read_table(spark, sf_dir, "orders"), "o_orderkey")


def flow10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_view(events(spark, sf_dir), FLOW10)


def flow42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_view(orders(spark, sf_dir), FLOW42)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_view(read_table(spark, sf_dir, "events"), MESSAGES)


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_view(read_table(spark, sf_dir, "events"), WHITELIST).distinct()


def result_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four linked tables of `scored_tables`, scored and stored once an application and read from there on."""
    root = f"{shared_dir(spark)}/scored-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    names = ("traffic", "threat", "attack", "action")
    if root not in _STORED:
        for name, df in scored_tables(spark, sf_dir).items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        _STORED.add(root)
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def dashboard_parts(spark: SparkSession, sf_dir: str, loads: int = 4) -> dict[str, DataFrame]:
    """Cells and newest predictions of `result_tables`, written by ``loads`` parts of the traffic as loads do it."""
    root = f"{shared_dir(spark)}/parts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if root not in _STORED:
        tables = result_tables(spark, sf_dir)
        keys = {"traffic": "id", "threat": "traffic_data_id", "attack": "traffic_data_id", "action": "attack_prediction_id"}
        for k in range(loads):
            own = {name: df.where(F.pmod(F.col(keys[name]), F.lit(loads)) == k) for name, df in tables.items()}
            for name, part in (("cells", table_cells(own)), ("newest", table_newest(own))):
                part.coalesce(1).write.mode("overwrite" if k == 0 else "append").parquet(f"{root}/{name}")
        _STORED.add(root)
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("cells", "newest")}


# Roots that this process has filled.
_STORED: set[str] = set()


def scored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four linked tables: events are traffic with a threat prediction each, orders are attack predictions.

    An attack prediction belongs to the traffic row with its own id, so some
    traffic has one and some predictions have no traffic here.
    """
    flows = as_view(events(spark, sf_dir), FLOW10 | {k: v for k, v in MESSAGES.items() if k != "id"})
    traffic = pack_features(flows, THREAT_LEGACY).select("id", "created_at", "features", "source", "batch_id")
    threat = rule_threat_score(flow10(spark, sf_dir)).select(
        "id",
        F.col("id").alias("traffic_data_id"),
        "created_at",
        "prediction_score",
        "is_attack",
        "threshold",
        "model_version",
    )
    attack = rule_attack_class(flow42(spark, sf_dir)).select(
        "id",
        F.col("id").alias("traffic_data_id"),
        "created_at",
        "attack_type_encoded",
        "attack_type_name",
        "confidence",
        "model_version",
    )
    return {"traffic": traffic, "threat": threat, "attack": attack, "action": action_rows(attack)}


def flow_map(flows: DataFrame) -> DataFrame:
    """Attack-profile flows with their features as a map."""
    return pack_features(flows, ATTACK_PROFILE).select("id", "created_at", "features")
