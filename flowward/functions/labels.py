"""Expressions that turn codes, scores and names into what a report shows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowward.profiles import ATTACK_LABELS


def label_name(code: Column, labels: tuple[str, ...] | list[str] = ATTACK_LABELS) -> Column:
    """Class name of a 0-based code; ``Unknown`` when out of range or null."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.get(names, code.cast("int")), F.lit("Unknown"))


def short_name(name: Column) -> Column:
    """Names over 20 characters cut to 20 with dots."""
    return F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 20), F.lit("..."))).otherwise(name)


def severity(score: Column) -> Column:
    """critical, high, medium or low."""
    known = ~F.isnan(score)
    return (
        F.when(known & (score >= 0.9), "critical")
        .when(known & (score >= 0.7), "high")
        .when(known & (score >= 0.5), "medium")
        .otherwise("low")
    )


def heat_level(count: Column, max_count: Column) -> Column:
    """0 for an empty cell, then 1 to 5 in steps of a fifth of the maximum."""
    intensity = count.cast("double") / F.greatest(max_count, F.lit(1)).cast("double")
    return (
        F.when(intensity == 0, 0)
        .when(intensity < 0.2, 1)
        .when(intensity < 0.4, 2)
        .when(intensity < 0.6, 3)
        .when(intensity < 0.8, 4)
        .otherwise(5)
    )


def version_string(at: Column | None = None) -> Column:
    """``YYYYMMDD_HHMMSS`` of a time, now by default."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")
