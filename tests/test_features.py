"""Detection, name matching, casting and range checks."""

import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from flowward.functions.casting import cast_csv_cell, cast_feature, inf_to_zero
from flowward.functions.ips import is_valid_ip
from flowward.operators.features import (
    FeatureError,
    detect_profile,
    extract,
    extract_messages,
    extract_with_profile,
    missing_names,
)
from flowward.operators.validation import DROP, FAILFAST, InvalidRowError, validate, with_errors
from flowward.profiles import ATTACK_PROFILE, THREAT_CURRENT, THREAT_LEGACY, FeatureProfile
from samples import attack, legacy
from test_rules import frame

NAN, INF = float("nan"), float("inf")


def test_profile_names():
    assert len(ATTACK_PROFILE.columns) == len(set(ATTACK_PROFILE.columns)) == 42
    assert ATTACK_PROFILE.columns[8:10] == ["flow_bytes_per_s", "flow_packets_per_s"]
    assert "down_up_ratio" in ATTACK_PROFILE.columns and "fwd_avg_bytes_per_bulk" in ATTACK_PROFILE.columns
    with pytest.raises(ValueError):
        FeatureProfile("x", "threat_detection", ("a", "a"), ("n", "y"))


def test_detection_by_exact_names():
    assert detect_profile(THREAT_LEGACY.features) is THREAT_LEGACY
    assert detect_profile(THREAT_CURRENT.features) is THREAT_CURRENT
    both = set(THREAT_LEGACY.features) | set(THREAT_CURRENT.features)
    assert detect_profile(sorted(both)) is THREAT_CURRENT
    leading = [f for f in ATTACK_PROFILE.features if f.startswith(" ")]
    seven = [f.strip() if f in leading[:7] else f for f in ATTACK_PROFILE.features]
    eight = [f.strip() if f in leading[:8] else f for f in ATTACK_PROFILE.features]
    assert detect_profile(seven) is ATTACK_PROFILE
    with pytest.raises(FeatureError, match="34 attack"):
        detect_profile(eight)
    with pytest.raises(FeatureError):
        detect_profile(THREAT_LEGACY.features[:7])


def test_explicit_profile_rejects_the_other_header(spark):
    df = spark.createDataFrame([("1",) * 10], ", ".join(f"{f} string" for f in THREAT_LEGACY.features))
    assert extract(df)[1] is THREAT_LEGACY
    with pytest.raises(FeatureError, match="dst_host_diff_srv_rate"):
        extract(df, "threat_current")
    with pytest.raises(FeatureError, match="Invalid model type"):
        extract(df, "other")


def test_loose_names_and_extra_columns(spark):
    profile = FeatureProfile("custom", "threat_detection", ("Alpha", " beta"), ("n", "y"))
    df = spark.createDataFrame([("1", "2", "3")], "`ALPHA ` string, Beta string, other string")
    row = extract_with_profile(df, profile).first()
    assert (row["alpha"], row["beta"]) == (1.0, 2.0)
    with pytest.raises(FeatureError, match="other"):
        extract_with_profile(df, profile, allow_extra=False)
    with pytest.raises(FeatureError, match="Missing required features:  beta"):
        extract_with_profile(df.drop("Beta"), profile)
    assert missing_names(["Alpha"], profile) == [" beta"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("5", 5.0), (" 1e3\t", 1000.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("+2", 2.0), ("-inf", -INF),
        ("Infinity", INF), ("nan", NAN), ("-nan", NAN), ("true", 1.0), ("5d", None), ("0x10", None), ("abc", None),
        ("1__0", None), ("", None), (None, None), ("1,5", None),
    ],
)
def test_json_value_as_number(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(cast_feature(F.col("t"))).first()[0]
    assert got == want or (got is not None and want is not None and math.isnan(got) and math.isnan(want))


def test_csv_cell_and_infinities(spark):
    df = spark.createDataFrame([("",), (None,), ("NA",), ("7",), ("x",)], "t string")
    got = [r[0] for r in df.select(cast_csv_cell(F.col("t"))).collect()]
    assert all(math.isnan(v) for v in got[:3]) and got[3:] == [7.0, None]
    df = spark.createDataFrame([(INF,), (-INF,), (2.0,)], "v double")
    assert [r[0] for r in df.select(inf_to_zero(F.col("v"))).collect()] == [0.0, 0.0, 2.0]


def test_message_errors_name_the_feature(spark):
    payload = {f: "1" for f in THREAT_LEGACY.features} | {"count": "abc", "flag": None}
    payload.pop("service")
    df = spark.createDataFrame([(payload,)], "payload map<string,string>")
    row = extract_messages(df, THREAT_LEGACY).first()
    assert row["errors"] == [
        "Missing required feature: service",
        "Invalid value for feature 'flag': expected a number",
        "Invalid value for feature 'count': expected a number",
    ]


def test_exact_key_wins_over_a_loose_one(spark):
    payload = {f: "1" for f in ATTACK_PROFILE.features} | {"destination port": "9"}
    payload["ACTIVE MEAN "] = payload.pop("Active Mean")
    row = extract_messages(spark.createDataFrame([(payload,)], "payload map<string,string>"), ATTACK_PROFILE).first()
    assert (row["destination_port"], row["active_mean"], row["errors"]) == (1.0, 1.0, [])


@pytest.mark.parametrize(
    "change, valid",
    [
        ({"diff_srv_rate": 1.0}, True), ({"diff_srv_rate": 1.0001}, False), ({"diff_srv_rate": -0.1}, False),
        ({"same_srv_rate": NAN}, False), ({"src_bytes": 0.0}, True), ({"src_bytes": -1.0}, False),
        ({"src_bytes": NAN}, True), ({"src_bytes": INF}, True),
    ],
)
def test_threat_ranges(spark, change, valid):
    assert with_errors(frame(spark, [legacy(**change)]), THREAT_LEGACY).first()["valid"] is valid


@pytest.mark.parametrize(
    "change, valid",
    [
        ({"destination_port": 0.0}, True), ({"destination_port": 65535.0}, True), ({"destination_port": 65536.0}, False),
        ({"destination_port": -1.0}, False), ({"destination_port": NAN}, False), ({"flow_iat_mean": -1000.0}, True),
        ({"flow_iat_mean": -1000.5}, False), ({"down_up_ratio": -5000.0}, True), ({"flow_iat_mean": NAN}, True),
    ],
)
def test_attack_ranges(spark, change, valid):
    assert with_errors(frame(spark, [attack(**change)]), ATTACK_PROFILE).first()["valid"] is valid


def test_policies(spark):
    rows = [{"id": i} | legacy(count=-1.0 if i in (3, 5) else 1.0) for i in range(8)]
    df = frame(spark, rows)
    with pytest.raises(InvalidRowError, match="row 3: Feature 'count' must be non-negative"):
        validate(df, THREAT_LEGACY, FAILFAST)
    good, bad = validate(df, THREAT_LEGACY, DROP)
    assert (good.count(), sorted(r["id"] for r in bad.collect())) == (6, [3, 5])


def test_ip_syntax(spark):
    texts = [
        "1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
        "1:2:3:4:5:6:7", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "fe80::1%eth0", "12345::", "g::", "", "a.b",
        "1:2:3:4:5:6:7:8:9", "1.2.3.4\n", "::ffff:1.2.3.256",
    ]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", is_valid_ip(F.col("t")).alias("ok")).collect()}
    wanted = {}
    for t in texts:
        try:
            ipaddress.ip_address(t)
            wanted[t] = True
        except ValueError:
            wanted[t] = False
    assert got == wanted
