"""Rule-based scores as plain column expressions; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from flowward.functions.casting import greater
from flowward.profiles import ATTACK_PROFILE, DEFAULT_THRESHOLD, THREAT_LEGACY

_CHUNK_DIGITS = 15  # hex digits that fit a bigint


def feature_digest(columns: list[str]) -> Column:
    """md5 (hex) of all values written with six decimals, back to back."""
    text = F.format_string("%.6f" * len(columns), *[F.col(c) for c in columns])
    # Java spells special values differently from what the digest is defined on.
    text = F.replace(F.replace(text, F.lit("NaN"), F.lit("nan")), F.lit("Infinity"), F.lit("inf"))
    return F.md5(text.cast("binary"))


def digest_mod(digest: Column, m: int) -> Column:
    """The 128-bit number in ``digest`` modulo a small ``m``, in bigint arithmetic."""
    total = F.lit(0).cast("bigint")
    start = 1
    for length in (32 % _CHUNK_DIGITS, _CHUNK_DIGITS, _CHUNK_DIGITS):
        chunk = F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")
        total = (total * (16**length % m) + chunk % m) % m
        start += length
    return total


# The smallest modulus from which the remainders by 20, and by 3, 4 and 25, can be read.
THREAT_NOISE = 20
ATTACK_NOISE = 300


def threat_score(noise: Column) -> Column:
    """Threat probability of a ``threat_legacy`` record: indicator weights shifted by the digest modulo 20."""
    c = {name: F.col(name) for name in THREAT_LEGACY.columns}
    indicators = [
        (greater(c["count"] / 500, 0.5), 0.3),
        ((c["same_srv_rate"] < 0.3) | greater(c["same_srv_rate"], 0.95), 0.2),
        (greater(c["diff_srv_rate"], 0.5), 0.25),
        (greater(c["dst_host_srv_count"] / 255, 0.7), 0.25),
        (greater(c["src_bytes"] / 10000, 0.8) | greater(c["dst_bytes"] / 10000, 0.8), 0.15),
    ]
    # Added left to right in doubles, so equal inputs give equal bits everywhere.
    total = reduce(lambda acc, i: acc + F.when(i[0], i[1]).otherwise(0.0), indicators, F.lit(0.0))
    base = F.least(F.when(total == 0.0, 0.1).otherwise(total), F.lit(0.95))
    shifted = base + noise.cast("double") / 100 - 0.1
    return F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0))


def is_attack(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Strictly above the threshold; NaN is not an attack."""
    return greater(score, threshold)


def attack_class(noise: Column) -> Column:
    """Class code of an attack-profile record: the first matching rule decides.

    ``noise`` (the digest modulo 300) is used once, so that a filter on the class
    that Spark moves below the projection does not repeat the digest many times.
    """
    c = {name: F.col(name) for name in ATTACK_PROFILE.columns}
    port = c["destination_port"]
    web = port.isin(80.0, 443.0, 8080.0) & greater(c["psh_flag_count"], 0) & greater(c["ack_flag_count"], 10)
    flood = greater(c["flow_packets_per_s"], 1000)
    scan = greater(c["fin_flag_count"], 0) & greater(c["rst_flag_count"], 0) & (c["flow_duration"] < 1000)
    rate = c["flow_bytes_per_s"]
    bot = greater(rate, 5000) & (rate < 50000) & greater(c["ack_flag_count"], 5)
    long_flow = greater(c["flow_duration"], 100000) & greater(rate, 100)
    # Three web classes, then four flood classes.
    drawn = F.array(*[F.lit(x) for x in (9, 11, 12, 1, 5, 6, 8)])
    position = F.when(web, 0).otherwise(3) + noise % F.when(web, 3).otherwise(4)
    return F.coalesce(
        F.when(port == 21, 4)
        .when(port == 22, 7)
        .when(~web & flood & greater(c["total_fwd_packets"], 100), 2)
        .when(web | flood, F.get(drawn, position.cast("int")))
        .when(scan, 3)
        .when(bot, 10)
        .when(long_flow, 13),
        F.lit(0),
    )


def rule_confidence(noise: Column) -> Column:
    """Confidence between 0.75 and 0.99 taken from the digest."""
    return F.round(0.75 + (noise % 25).cast("double") / 100, 2)
