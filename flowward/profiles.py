"""Feature profiles, class labels and response actions.

A profile is data: an ordered feature list plus class labels. Every operator
that depends on a feature set takes a profile instead of hard-coding names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

THREAT = "threat_detection"
ATTACK = "attack_classification"

# Feature names of the two threat profiles, in model order.
THREAT_CURRENT_FEATURES = [
    "flag",
    "src_bytes",
    "dst_bytes",
    "count",
    "diff_srv_rate",
    "dst_host_srv_count",
    "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate",
]
THREAT_LEGACY_FEATURES = [
    "service",
    "flag",
    "src_bytes",
    "dst_bytes",
    "count",
    "same_srv_rate",
    "diff_srv_rate",
    "dst_host_srv_count",
    "dst_host_same_srv_rate",
    "dst_host_same_src_port_rate",
]

# The 42 flow-meter feature names, in model order; leading spaces are part of the name.
ATTACK_FEATURES = [
    " Destination Port",
    " Flow Duration",
    " Total Fwd Packets",
    "Total Length of Fwd Packets",
    " Fwd Packet Length Max",
    " Fwd Packet Length Min",
    "Bwd Packet Length Max",
    " Bwd Packet Length Min",
    "Flow Bytes/s",
    " Flow Packets/s",
    " Flow IAT Mean",
    " Flow IAT Std",
    " Flow IAT Min",
    "Bwd IAT Total",
    " Bwd IAT Std",
    "Fwd PSH Flags",
    " Bwd PSH Flags",
    " Fwd URG Flags",
    " Bwd URG Flags",
    " Fwd Header Length",
    " Bwd Header Length",
    " Bwd Packets/s",
    " Min Packet Length",
    "FIN Flag Count",
    " RST Flag Count",
    " PSH Flag Count",
    " ACK Flag Count",
    " URG Flag Count",
    " Down/Up Ratio",
    "Fwd Avg Bytes/Bulk",
    " Fwd Avg Packets/Bulk",
    " Fwd Avg Bulk Rate",
    " Bwd Avg Bytes/Bulk",
    " Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Init_Win_bytes_forward",
    " Init_Win_bytes_backward",
    " min_seg_size_forward",
    "Active Mean",
    " Active Std",
    " Active Max",
    " Idle Std",
]

# Attack class names by code (the dash in the web attacks is U+2013).
ATTACK_LABELS = [
    "BENIGN",
    "DoS Hulk",
    "DDoS",
    "PortScan",
    "FTP-Patator",
    "DoS slowloris",
    "DoS Slowhttptest",
    "SSH-Patator",
    "DoS GoldenEye",
    "Web Attack – Brute Force",
    "Bot",
    "Web Attack – XSS",
    "Web Attack – Sql Injection",
    "Infiltration",
]

# Response action per attack name: (action type, description, parameter name, parameter value).
ACTIONS = {
    "BENIGN": ("log_only", "No action needed for BENIGN traffic", None, None),
    "DoS Hulk": ("block_ip", "Blocking IP address: 192.168.1.1", "ip", "192.168.1.1"),
    "DDoS": ("restart_service", "Restarting service: apache2", "service", "apache2"),
    "PortScan": ("alert_admin", "Alert admin: Port scanning detected", "message", "Port scanning detected"),
    "FTP-Patator": ("block_ip", "Blocking IP address: 192.168.1.2", "ip", "192.168.1.2"),
    "DoS slowloris": ("restart_service", "Restarting service: nginx", "service", "nginx"),
    "DoS Slowhttptest": ("restart_service", "Restarting service: nginx", "service", "nginx"),
    "SSH-Patator": ("block_ip", "Blocking IP address: 192.168.1.3", "ip", "192.168.1.3"),
    "DoS GoldenEye": ("restart_service", "Restarting service: apache2", "service", "apache2"),
    "Web Attack – Brute Force": ("alert_admin", "Alert admin: Brute force attack detected", "message", "Brute force attack detected"),
    "Bot": ("alert_admin", "Alert admin: Bot activity detected", "message", "Bot activity detected"),
    "Web Attack – XSS": ("alert_admin", "Alert admin: XSS attack detected", "message", "XSS attack detected"),
    "Web Attack – Sql Injection": ("alert_admin", "Alert admin: SQL injection detected", "message", "SQL injection detected"),
    "Infiltration": ("alert_admin", "Alert admin: Infiltration detected", "message", "Infiltration detected"),
}

# Data sources known from the start (name, description, enabled, parameters).
DEFAULT_SOURCES = [
    ("packet_capture", "Network packet capture from server interface", False, {"interface": "any", "buffer_size": "1000"}),
    ("external_kafka", "External data providers via Kafka", False, {"topic": "external-traffic"}),
    ("internal_kafka", "Internal test data stream", True, {"topic": "network-traffic"}),
]

RULE_THREAT_VERSION = "ensemble_v1"
RULE_ATTACK_VERSION = "decision_tree_v1"
DEFAULT_THRESHOLD = 0.5

# How many exact name hits decide the record type.
ATTACK_MIN_HITS = 35
THREAT_MIN_HITS = 8


def snake_name(feature: str) -> str:
    """Column-friendly form of a feature name, e.g. ``Flow Bytes/s`` -> ``flow_bytes_per_s``."""
    text = feature.strip().lower()
    if text.endswith("/s"):
        text = text[:-2] + " per s"
    elif text.endswith("/bulk"):
        text = text[:-5] + " per bulk"
    return text.replace("/", " ").replace(" ", "_")


@dataclass(frozen=True)
class FeatureProfile:
    """An ordered feature list with its class labels.

    ``columns`` are the names used inside the engine; ``features`` are the names
    in files and messages.
    """

    name: str
    model_type: str
    features: tuple[str, ...]
    class_labels: tuple[str, ...]
    fuzzy: bool = True
    notes: str = ""

    def __post_init__(self):
        if not self.features:
            raise ValueError("A profile needs at least one feature")
        if len(set(self.features)) != len(self.features):
            raise ValueError("Profile features must be unique")
        if len(self.class_labels) < 2:
            raise ValueError("A profile needs at least two class labels")
        if self.model_type not in (THREAT, ATTACK):
            raise ValueError(f"Invalid model type: {self.model_type}")

    @property
    def columns(self) -> list[str]:
        return [snake_name(f) for f in self.features]


THREAT_CURRENT = FeatureProfile(
    "threat_current", THREAT, tuple(THREAT_CURRENT_FEATURES), ("Normal", "Attack"), fuzzy=False
)
THREAT_LEGACY = FeatureProfile(
    "threat_legacy", THREAT, tuple(THREAT_LEGACY_FEATURES), ("Normal", "Attack"), fuzzy=False
)
ATTACK_PROFILE = FeatureProfile("attack", ATTACK, tuple(ATTACK_FEATURES), tuple(ATTACK_LABELS))

# The first profile of a type wins a tie on name hits.
BUILTIN_PROFILES = (THREAT_CURRENT, THREAT_LEGACY, ATTACK_PROFILE)


def action_for(attack_name: str) -> tuple[str, str, dict[str, str]]:
    """(action type, description, parameters) recorded for an attack name."""
    action_type, description, key, value = ACTIONS[attack_name]
    return action_type, description, {} if key is None else {key: value}


def fixed_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A small driver-defined table as a local relation (the planner knows its size)."""
    return spark.createDataFrame(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}))


def label_dim(spark: SparkSession, labels: tuple[str, ...] = tuple(ATTACK_LABELS)) -> DataFrame:
    """(attack_type_encoded, attack_type_name) for every class."""
    return fixed_table(
        spark,
        {"attack_type_encoded": list(range(len(labels))), "attack_type_name": list(labels)},
        {"attack_type_encoded": pa.int32(), "attack_type_name": pa.string()},
    )


def action_dim(spark: SparkSession) -> DataFrame:
    """One row per known attack name with the action to record."""
    names = list(ACTIONS)
    rows = [action_for(n) for n in names]
    return fixed_table(
        spark,
        {
            "attack_type_name": names,
            "action_type": [r[0] for r in rows],
            "action_description": [r[1] for r in rows],
            "action_params": [list(r[2].items()) for r in rows],
        },
        {
            "attack_type_name": pa.string(),
            "action_type": pa.string(),
            "action_description": pa.string(),
            "action_params": pa.map_(pa.string(), pa.string()),
        },
    )


def default_sources(spark: SparkSession) -> DataFrame:
    """The seed rows of the data-source configuration table."""
    return fixed_table(
        spark,
        {
            "source_name": [s[0] for s in DEFAULT_SOURCES],
            "description": [s[1] for s in DEFAULT_SOURCES],
            "is_enabled": [s[2] for s in DEFAULT_SOURCES],
            "config_params": [list(s[3].items()) for s in DEFAULT_SOURCES],
        },
        {
            "source_name": pa.string(),
            "description": pa.string(),
            "is_enabled": pa.bool_(),
            "config_params": pa.map_(pa.string(), pa.string()),
        },
    )
