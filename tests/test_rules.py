"""Rule scorers against a plain restatement of the rules, row by row."""

import hashlib
import random

from pyspark.sql import functions as F

from flowward.functions.rules import digest_mod, is_attack
from flowward.operators.scoring import attach_actions, rule_attack_class, rule_threat_score
from flowward.profiles import ATTACK_LABELS, ATTACK_PROFILE, THREAT_LEGACY
from samples import attack, legacy

NAN, INF = float("nan"), float("inf")


def number(row, columns) -> int:
    return int(hashlib.md5("".join(f"{row[c]:.6f}" for c in columns).encode()).hexdigest(), 16)


def expected_score(r) -> float:
    weights = [
        (0.3, r["count"] / 500 > 0.5),
        (0.2, r["same_srv_rate"] < 0.3 or r["same_srv_rate"] > 0.95),
        (0.25, r["diff_srv_rate"] > 0.5),
        (0.25, r["dst_host_srv_count"] / 255 > 0.7),
        (0.15, max(r["src_bytes"], 0) / 10000 > 0.8 or max(r["dst_bytes"], 0) / 10000 > 0.8),
    ]
    base = 0.0
    for weight, hit in weights:
        base += weight if hit else 0
    base = min(base or 0.1, 0.95)
    return min(1.0, max(0.0, base + number(r, THREAT_LEGACY.columns) % 20 / 100 - 0.1))


def expected_class(r) -> int:
    n = number(r, ATTACK_PROFILE.columns)
    if r["destination_port"] in (21, 22):
        return 4 if r["destination_port"] == 21 else 7
    if r["destination_port"] in (80, 443, 8080) and r["psh_flag_count"] > 0 and r["ack_flag_count"] > 10:
        return (9, 11, 12)[n % 3]
    if r["flow_packets_per_s"] > 1000:
        return 2 if r["total_fwd_packets"] > 100 else (1, 5, 6, 8)[n % 4]
    if r["fin_flag_count"] > 0 and r["rst_flag_count"] > 0 and r["flow_duration"] < 1000:
        return 3
    if 5000 < r["flow_bytes_per_s"] < 50000 and r["ack_flag_count"] > 5:
        return 10
    return 13 if r["flow_duration"] > 100000 and r["flow_bytes_per_s"] > 100 else 0


def frame(spark, rows):
    names = list(rows[0])
    schema = ", ".join(f"`{n}` double" if n != "id" else "id bigint" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_threat_scores_match_the_rules(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        rows.append(
            {"id": i}
            | legacy(
                src_bytes=rng.choice([0.0, 8000.0, 8000.5, rng.uniform(0, 20000), NAN, INF]),
                dst_bytes=round(rng.uniform(0, 12000), 2),
                count=float(rng.choice([250, 251, rng.randrange(512)])),
                same_srv_rate=rng.choice([0.3, 0.95, 0.299999, 0.96, rng.random()]),
                diff_srv_rate=rng.choice([0.5, 0.51, rng.random()]),
                dst_host_srv_count=float(rng.randrange(256)),
            )
        )
    got = {r["id"]: r["prediction_score"] for r in rule_threat_score(frame(spark, rows)).collect()}
    assert got == {r["id"]: expected_score(r) for r in rows}


def test_attack_classes_match_the_rules(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        rows.append(
            {"id": i}
            | attack(
                destination_port=float(rng.choice([21, 22, 80, 443, 8080, 25])),
                flow_duration=float(rng.choice([500, 1000, 100000, 100001, 5])),
                total_fwd_packets=float(rng.choice([100, 101])),
                flow_bytes_per_s=rng.choice([100.0, 101.0, 5000.0, 5001.5, 50000.0, NAN]),
                flow_packets_per_s=float(rng.choice([10, 10, 1000, 1001])),
                fin_flag_count=float(rng.choice([0, 1])),
                rst_flag_count=float(rng.choice([0, 1])),
                psh_flag_count=float(rng.choice([0, 2])),
                ack_flag_count=rng.choice([5.0, 6.0, 10.0, 11.0, NAN]),
                idle_std=round(rng.uniform(-5, 5), 3),
            )
        )
    got = rule_attack_class(frame(spark, rows)).collect()
    assert {r["id"]: r["attack_type_encoded"] for r in got} == {r["id"]: expected_class(r) for r in rows}
    for r in got:
        n = number(rows[r["id"]], ATTACK_PROFILE.columns)
        assert r["confidence"] == round(0.75 + n % 25 / 100, 2)
        assert r["attack_type_name"] == ATTACK_LABELS[r["attack_type_encoded"]]


def test_digest_modulo_is_that_of_the_whole_number(spark):
    texts = [hashlib.md5(str(i).encode()).hexdigest() for i in range(50)] + ["0" * 32, "f" * 32]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    for m in (3, 4, 20, 25, 300):
        got = df.select("h", digest_mod(F.col("h"), m).alias("r")).collect()
        assert all(r["r"] == int(r["h"], 16) % m for r in got)


def test_threshold_is_strict_and_nan_is_no_attack(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (NAN,)], "s double")
    assert [r[0] for r in df.select(is_attack(F.col("s"))).collect()] == [False, True, False]


def test_unknown_attack_is_only_logged(spark):
    df = spark.createDataFrame([("Worm",), ("DDoS",), ("BENIGN",)], "attack_type_name string")
    got = {r["attack_type_name"]: r for r in attach_actions(df).collect()}
    assert got["Worm"]["action_type"] == "log_only"
    assert got["Worm"]["action_description"] == "No action defined for Worm"
    assert got["Worm"]["action_params"] == {}
    assert got["DDoS"]["action_params"] == {"service": "apache2"}
    assert got["BENIGN"]["action_description"] == "No action needed for BENIGN traffic"
