"""Column scaling: statistics in one aggregate, applied as plain arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowward.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Scaling:
    """Per column a centre and a width; a constant column has width 1 and so scales to 0."""

    columns: tuple[str, ...]
    center: tuple[float, ...]
    width: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(w) for c, m, w in zip(self.columns, self.center, self.width)}
        )


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Mean and population standard deviation."""
    aggs = [f(F.col(f"`{c}`")) for c in cols for f in (F.avg, F.stddev_pop)]
    row = df.agg(*aggs).first()
    return _scaling(cols, row[0::2], row[1::2])  # an all-null column has neither and is left as it is


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Exact median and interquartile range."""
    found = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
    ranks = [[found.get((c, p)) for p in (0.25, 0.5, 0.75)] for c in cols]
    widths = [None if low is None or high is None else high - low for low, _, high in ranks]
    return _scaling(cols, [middle for _, middle, _ in ranks], widths)


def scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    return scaling.transform(df)


def _scaling(cols, center, width) -> Scaling:
    return Scaling(tuple(cols), tuple(float(c or 0) for c in center), tuple(float(w or 1) for w in width))
