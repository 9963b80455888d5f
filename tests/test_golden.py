"""Names, codes, actions and scores written out here on their own, so that a slip in the profiles shows."""

import pytest

from flowward.operators.scoring import attach_actions, rule_attack_class, rule_threat_score
from flowward.profiles import ATTACK_PROFILE, THREAT_CURRENT, THREAT_LEGACY, action_dim, label_dim

LEGACY = (
    "service flag src_bytes dst_bytes count same_srv_rate diff_srv_rate dst_host_srv_count "
    "dst_host_same_srv_rate dst_host_same_src_port_rate"
)
CURRENT = (
    "flag src_bytes dst_bytes count diff_srv_rate dst_host_srv_count dst_host_same_srv_rate "
    "dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate"
)
ATTACK = (
    "destination_port flow_duration total_fwd_packets total_length_of_fwd_packets fwd_packet_length_max "
    "fwd_packet_length_min bwd_packet_length_max bwd_packet_length_min flow_bytes_per_s flow_packets_per_s "
    "flow_iat_mean flow_iat_std flow_iat_min bwd_iat_total bwd_iat_std fwd_psh_flags bwd_psh_flags fwd_urg_flags "
    "bwd_urg_flags fwd_header_length bwd_header_length bwd_packets_per_s min_packet_length fin_flag_count "
    "rst_flag_count psh_flag_count ack_flag_count urg_flag_count down_up_ratio fwd_avg_bytes_per_bulk "
    "fwd_avg_packets_per_bulk fwd_avg_bulk_rate bwd_avg_bytes_per_bulk bwd_avg_packets_per_bulk bwd_avg_bulk_rate "
    "init_win_bytes_forward init_win_bytes_backward min_seg_size_forward active_mean active_std active_max idle_std"
)
# Code, class, action type, parameter.
CLASSES = [
    (0, "BENIGN", "log_only", {}),
    (1, "DoS Hulk", "block_ip", {"ip": "192.168.1.1"}),
    (2, "DDoS", "restart_service", {"service": "apache2"}),
    (3, "PortScan", "alert_admin", {"message": "Port scanning detected"}),
    (4, "FTP-Patator", "block_ip", {"ip": "192.168.1.2"}),
    (5, "DoS slowloris", "restart_service", {"service": "nginx"}),
    (6, "DoS Slowhttptest", "restart_service", {"service": "nginx"}),
    (7, "SSH-Patator", "block_ip", {"ip": "192.168.1.3"}),
    (8, "DoS GoldenEye", "restart_service", {"service": "apache2"}),
    (9, "Web Attack – Brute Force", "alert_admin", {"message": "Brute force attack detected"}),
    (10, "Bot", "alert_admin", {"message": "Bot activity detected"}),
    (11, "Web Attack – XSS", "alert_admin", {"message": "XSS attack detected"}),
    (12, "Web Attack – Sql Injection", "alert_admin", {"message": "SQL injection detected"}),
    (13, "Infiltration", "alert_admin", {"message": "Infiltration detected"}),
]


def test_feature_order():
    assert THREAT_LEGACY.columns == LEGACY.split()
    assert THREAT_CURRENT.columns == CURRENT.split()
    assert ATTACK_PROFILE.columns == ATTACK.split()


def test_labels_and_actions(spark):
    labels = {r["attack_type_encoded"]: r["attack_type_name"] for r in label_dim(spark).collect()}
    assert labels == {code: name for code, name, _, _ in CLASSES}
    actions = {r["attack_type_name"]: (r["action_type"], r["action_params"] or {}) for r in action_dim(spark).collect()}
    assert actions == {name: (kind, params) for _, name, kind, params in CLASSES}


def flow(spark, names: str, **values):
    columns = names.split()
    row = tuple(float(values.get(c, 0)) for c in columns)
    return spark.createDataFrame([(1, *row)], "id long, " + ", ".join(f"`{c}` double" for c in columns))


@pytest.mark.parametrize(
    "values, low, high",
    [
        ({"same_srv_rate": 0.5}, 0.0, 0.09),  # no rule fits: 0.1 and the noise of -0.1 to 0.09
        ({"count": 400, "same_srv_rate": 0.5}, 0.2, 0.39),
        ({"count": 400, "same_srv_rate": 0.1, "diff_srv_rate": 0.9, "dst_host_srv_count": 250, "src_bytes": 9000}, 0.85, 1.0),
    ],
)
def test_threat_scores(spark, values, low, high):
    score = rule_threat_score(flow(spark, LEGACY, **values)).first()["prediction_score"]
    assert low - 1e-9 <= score <= max(high, 0.2 if low == 0 else high) + 1e-9


@pytest.mark.parametrize(
    "values, codes",
    [
        ({"destination_port": 21}, {4}),
        ({"destination_port": 22}, {7}),
        ({"destination_port": 443, "psh_flag_count": 1, "ack_flag_count": 11}, {9, 11, 12}),
        ({"flow_packets_per_s": 1001, "total_fwd_packets": 101}, {2}),
        ({"flow_packets_per_s": 1001}, {1, 5, 6, 8}),
        ({"fin_flag_count": 1, "rst_flag_count": 1, "flow_duration": 999}, {3}),
        ({"flow_bytes_per_s": 6000, "ack_flag_count": 6}, {10}),
        ({"flow_duration": 100001, "flow_bytes_per_s": 101}, {13}),
        ({}, {0}),
    ],
)
def test_attack_classes(spark, values, codes):
    row = attach_actions(rule_attack_class(flow(spark, ATTACK, **values))).first()
    assert row["attack_type_encoded"] in codes
    assert (row["attack_type_name"], row["action_type"]) == CLASSES[row["attack_type_encoded"]][1:3]
