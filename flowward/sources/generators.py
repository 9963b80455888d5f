"""Labelled sample flows for trying out training: distributions per class, any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowward.operators.recent import shuffle_rows
from flowward.operators.sets import union_all
from flowward.profiles import ATTACK_FEATURES, ATTACK_LABELS, THREAT_LEGACY_FEATURES

# Per class the distribution of each feature: a choice of words, exponential(mean),
# poisson(mean) or uniform(low, high).
NORMAL = {
    "service": ["http", "ftp", "smtp"],
    "flag": ["SF", "S0", "REJ"],
    "src_bytes": ("exponential", 500),
    "dst_bytes": ("exponential", 1000),
    "count": ("poisson", 10),
    "same_srv_rate": ("uniform", 0.7, 1.0),
    "diff_srv_rate": ("uniform", 0.0, 0.3),
    "dst_host_srv_count": ("poisson", 20),
    "dst_host_same_srv_rate": ("uniform", 0.7, 1.0),
    "dst_host_same_src_port_rate": ("uniform", 0.5, 1.0),
}
ANOMALY = {
    "service": ["private", "http", "other"],
    "flag": ["S0", "REJ", "RSTO"],
    "src_bytes": ("exponential", 50),
    "dst_bytes": ("exponential", 100),
    "count": ("poisson", 100),
    "same_srv_rate": ("uniform", 0.0, 0.3),
    "diff_srv_rate": ("uniform", 0.5, 1.0),
    "dst_host_srv_count": ("poisson", 200),
    "dst_host_same_srv_rate": ("uniform", 0.0, 0.3),
    "dst_host_same_src_port_rate": ("uniform", 0.0, 0.3),
}


def _uniform(seed: int) -> Column:
    """A number in [0, 1) fixed by the row's id and the seed, whatever partition it is made in."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))


def _normal(seed: int) -> Column:
    """A standard normal draw out of two uniform ones."""
    return F.sqrt(-2 * F.log1p(-_uniform(seed))) * F.cos(2 * math.pi * _uniform(seed + 100_000))


def _poisson(mean: float, seed: int) -> Column:
    """Number of cumulative probabilities under a uniform draw; the table ends where doubles reach 1."""
    cdf, total, k = [], 0.0, 0
    while total < 1 - 1e-15 and k < mean + 20 * math.sqrt(mean) + 20:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        cdf.append(total)
        k += 1
    steps = F.array(*[F.lit(p) for p in cdf])
    draw = F.transform(F.array(_uniform(seed)), lambda u: F.size(F.filter(steps, lambda p: p < u)))
    return F.get(draw, F.lit(0))


def _draw(spec, seed: int) -> Column:
    if isinstance(spec, list):
        return F.element_at(F.array(*[F.lit(w) for w in spec]), (F.floor(_uniform(seed) * len(spec)) + 1).cast("int"))
    kind, *args = spec
    if kind == "exponential":
        return -F.log1p(-_uniform(seed)) * args[0]
    if kind == "poisson":
        return _poisson(args[0], seed)
    low, high = args
    return _uniform(seed) * (high - low) + low


def gen_threat(spark: SparkSession, n_normal: int = 800, n_attack: int = 200, seed: int = 42) -> DataFrame:
    """Threat records with ``class`` normal or anomaly, in shuffled order."""

    def rows(n: int, specs: dict, label: str, first_seed: int) -> DataFrame:
        cols = [_draw(specs[f], first_seed + i).alias(f) for i, f in enumerate(THREAT_LEGACY_FEATURES)]
        return spark.range(n).select(*cols, F.lit(label).alias("class"))

    both = union_all(rows(n_normal, NORMAL, "normal", seed), rows(n_attack, ANOMALY, "anomaly", seed + 1000))
    return shuffle_rows(both, seed)


def gen_attack(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Attack records: gaussian features with deviation 1000 and a random `` Label``."""
    cols = [(_normal(seed + i) * 1000).alias(f) for i, f in enumerate(ATTACK_FEATURES)]
    return spark.range(n).select(*cols, _draw(ATTACK_LABELS, seed + 5000).alias(" Label"))
