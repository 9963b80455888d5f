"""Range checks as error arrays, and what to do with the rows that fail them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowward.functions.casting import INF
from flowward.profiles import THREAT, FeatureProfile, snake_name

# Which threat features are rates in [0, 1] and which are non-negative amounts.
RATE_FEATURES = [
    "same_srv_rate",
    "diff_srv_rate",
    "dst_host_same_srv_rate",
    "dst_host_same_src_port_rate",
    "dst_host_diff_srv_rate",
    "dst_host_srv_diff_host_rate",
]
AMOUNT_FEATURES = ["src_bytes", "dst_bytes", "count", "dst_host_srv_count"]
LOWEST_NEGATIVE = -1000.0

# The wording of all errors below, which clients show and match.
FAILFAST = "FAILFAST"
DROP = "DROP"


class InvalidRowError(ValueError):
    """A row failed validation under the FAILFAST policy."""


def _present(checks: list[Column]) -> Column:
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def rate_errors(profile: FeatureProfile) -> Column:
    """Rates of the profile outside [0, 1]; NaN is outside."""
    return _present(
        [
            F.when(~F.col(f).between(0.0, 1.0), f"Feature '{f}' must be between 0 and 1")
            for f in RATE_FEATURES
            if f in profile.features
        ]
    )


def non_negative_errors(profile: FeatureProfile) -> Column:
    """Amounts of the profile below 0; NaN passes."""
    return _present(
        [
            F.when(F.col(f) < 0, f"Feature '{f}' must be non-negative")
            for f in AMOUNT_FEATURES
            if f in profile.features
        ]
    )


def port_error() -> Column:
    """A destination port outside [0, 65535]; NaN is outside."""
    return _present(
        [F.when(~F.col("destination_port").between(0.0, 65535.0), "Destination Port must be between 0 and 65535")]
    )


def negative_errors(profile: FeatureProfile) -> Column:
    """Features other than ratios below -1000."""
    checked = [f for f in profile.features if "Ratio" not in f]
    values = F.array(*[F.col(snake_name(f)) for f in checked])
    names = F.array(*[F.lit(f) for f in checked])
    low = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda e: e["value"] < LOWEST_NEGATIVE)
    return F.transform(
        low, lambda e: F.concat(F.lit("Feature '"), e["name"], F.lit("' has unrealistic negative value"))
    )


def range_errors(profile: FeatureProfile) -> Column:
    """All range errors of a row, in checking order."""
    if profile.model_type == THREAT:
        return F.concat(rate_errors(profile), non_negative_errors(profile))
    checks = negative_errors(profile)
    return F.concat(port_error(), checks) if "destination_port" in profile.columns else checks


def not_finite_errors(profile: FeatureProfile) -> Column:
    """Features that are no number, or beyond all numbers: rules can take them, trained models cannot."""
    values = F.array(*[F.struct(F.lit(f).alias("name"), F.col(snake_name(f)).alias("value")) for f in profile.features])
    odd = F.filter(values, lambda e: F.isnan(e["value"]) | (F.abs(e["value"]) == INF))
    return F.transform(odd, lambda e: F.concat(F.lit("Feature '"), e["name"], F.lit("' is not a finite number")))


def with_errors(df: DataFrame, profile: FeatureProfile) -> DataFrame:
    """Add ``errors`` (appended to those already there) and ``valid``."""
    found = range_errors(profile)
    if "errors" in df.columns:
        found = F.concat(F.col("errors"), found)
    return df.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)


def validate(
    df: DataFrame, profile: FeatureProfile, policy: str = FAILFAST, order: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and quarantined rows.

    FAILFAST raises for the first bad row in ``order``, naming its 0-based
    position and its first error; DROP passes the bad rows on in the second frame.
    """
    checked = with_errors(df, profile)
    good = checked.where("valid").drop("errors", "valid")
    bad = checked.where(~F.col("valid")).drop("valid")
    if policy == FAILFAST:
        first = bad.agg(F.min(F.struct(F.col(order).alias("at"), F.col("errors"))).alias("first")).first()["first"]
        if first is not None:
            position = df.where(F.col(order) < F.lit(first["at"])).count()
            raise InvalidRowError(f"Error processing row {position}: {first['errors'][0]}")
    elif policy != DROP:
        raise ValueError(f"Unknown policy: {policy}")
    return good, bad


def drop_invalid(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null, NaN or infinite value in any of ``cols`` (all by default)."""
    types = dict(df.dtypes)
    keep = F.lit(True)
    for c in cols or df.columns:
        col = F.col(f"`{c}`")
        keep = keep & col.isNotNull()
        if types[c] in ("double", "float"):
            keep = keep & ~F.isnan(col) & (F.abs(col) != INF)
    return df.where(keep)
