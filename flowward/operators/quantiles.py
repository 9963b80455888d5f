"""Exact quantiles in a few wide passes, however many columns and ranks are asked for.

Spark's exact ``percentile`` keeps every distinct value in one task's memory.
Here one aggregate sketches all columns at once (approximate percentiles merge
like any aggregate) and closes each wanted rank in between two values. One
counting pass over all of them tells exactly where the rank lies. Both are done
again inside the intervals, thousands of times narrower each time, until what
is left of a rank is small enough to sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from flowward.profiles import fixed_table

# Values left for one rank that a single task may sort.
SORT_LIMIT = 100_000
# A sketched percentile is off by 1 / _ACCURACY of the values at most.
_ACCURACY = 10_000


@dataclass
class _Open:
    """A rank not yet found: strictly between ``lo`` and ``hi`` (None: no bound).

    ``below`` values are at or under ``lo``, ``top`` values are under ``hi``.
    """

    lo: float | None
    hi: float | None
    below: int
    top: int

    @property
    def inside(self) -> int:
        return self.top - self.below

    def around(self, rank: int) -> list[float]:
        """Two percentiles of the values inside that the rank lies between, as far as a sketch can tell."""
        at, slack = (rank - self.below + 0.5) / self.inside, 2 / _ACCURACY
        return [max(at - slack, 0.0), min(at + slack, 1.0)]


def _value(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def _between(v: Column, lo: float | None, hi: float | None) -> Column:
    inside = v.isNotNull()
    if lo is not None:
        inside &= v > F.lit(lo)
    if hi is not None:
        inside &= v < F.lit(hi)
    return inside


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], sort_limit: int = SORT_LIMIT
) -> DataFrame:
    """(column, prob, value) with linear interpolation between neighbouring ranks; missing values are left out.

    The driver holds a few numbers per column and probability, never data rows. A column without values has no row.
    """
    found, _ = quantiles_and(df, cols, probs, sort_limit=sort_limit)
    return fixed_table(
        df.sparkSession,
        {"column": [c for c, _ in found], "prob": [p for _, p in found], "value": list(found.values())},
        {"column": pa.string(), "prob": pa.float64(), "value": pa.float64()},
    )


def quantiles_and(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], also: Sequence[Column] = (), sort_limit: int = SORT_LIMIT
) -> tuple[dict[tuple[str, float], float], Row | None]:
    """Quantiles by column and probability, and the row of the aggregates ``also``, which the first pass takes along."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}, df.agg(*also).first() if also else None
    first = df.agg(*[F.count(_value(c)) for c in cols], *also).first()
    sizes = {c: n for c, n in zip(cols, first) if n}
    wanted, open_ranks = [], {}  # (column, prob, fraction, lower rank, upper rank); (column, rank) to its interval
    for c, n in sizes.items():
        for p in probs:
            at = (n - 1) * p
            low, high = math.floor(at), math.ceil(at)
            wanted.append((c, p, at - low, low, high))
            for k in (low, high):
                open_ranks[(c, k)] = _Open(None, None, 0, n)
    settled: dict[tuple[str, int], float] = {}
    while any(r.inside > sort_limit for r in open_ranks.values()):
        _narrow(df, open_ranks, settled)
    if open_ranks:
        settled |= _sorted_ranks(df, open_ranks)
    found = {}
    for c, p, fraction, low, high in wanted:
        a, b = settled[(c, low)], settled[(c, high)]
        found[(c, p)] = a if low == high else a + (b - a) * fraction
    return found, Row(*first[len(cols) :])


def _narrow(df: DataFrame, open_ranks: dict[tuple[str, int], _Open], settled: dict) -> None:
    """Two passes over the data, a sketch and a count: tighten every interval, or settle its rank on a bound.

    Both bounds are values from inside, so each round leaves out at least these and the rounds come to an end.
    """
    intervals: dict[tuple, list[int]] = {}
    for (c, k), r in open_ranks.items():
        intervals.setdefault((c, r.lo, r.hi), []).append(k)
    sketches = []
    for (c, lo, hi), ranks in intervals.items():
        percentages = [p for k in ranks for p in open_ranks[(c, k)].around(k)]
        v = _value(c)
        sketches.append(F.percentile_approx(F.when(_between(v, lo, hi), v), percentages, _ACCURACY))
    cuts = {}
    for ((c, _, _), ranks), values in zip(intervals.items(), df.agg(*sketches).first()):
        for i, k in enumerate(ranks):
            cuts[(c, k)] = (values[2 * i], values[2 * i + 1])
    bounds = list(dict.fromkeys((c, b) for (c, _), cut in cuts.items() for b in cut))
    counted = df.agg(*[f for c, b in bounds for f in (F.count_if(_value(c) < F.lit(b)), F.count_if(_value(c) <= F.lit(b)))]).first()
    under, upto = dict(zip(bounds, counted[0::2])), dict(zip(bounds, counted[1::2]))
    for (c, k), (a, b) in cuts.items():
        r = open_ranks[(c, k)]
        if k < under[(c, a)]:
            r.hi, r.top = a, under[(c, a)]
        elif k < upto[(c, a)]:
            settled[(c, k)] = a
        elif k < under[(c, b)]:
            r.lo, r.below, r.hi, r.top = a, upto[(c, a)], b, under[(c, b)]
        elif k < upto[(c, b)]:
            settled[(c, k)] = b
        else:
            r.lo, r.below = b, upto[(c, b)]
        if (c, k) in settled:
            del open_ranks[(c, k)]


def _sorted_ranks(df: DataFrame, open_ranks: dict[tuple[str, int], _Open]) -> dict[tuple[str, int], float]:
    """Settle ranks whose intervals hold few values, in one pass: count equal values, then sort what is left.

    Ranks that share an interval are settled by one sort of it.
    """
    groups: dict[tuple, list[int]] = {}
    for (c, k), r in open_ranks.items():
        groups.setdefault((c, r.lo, r.hi, r.below), []).append(k)
    cells = []
    for g, (c, lo, hi, _) in enumerate(groups):
        v = _value(c)
        cells.append(F.when(_between(v, lo, hi), F.struct(F.lit(g).alias("group"), v.alias("value"))))
    counted = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("group", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("value"))
    asked = [(g, c, k, k - below) for g, ((c, _, _, below), ranks) in enumerate(groups.items()) for k in ranks]
    ranks = fixed_table(
        df.sparkSession,
        {name: [a[i] for a in asked] for i, name in enumerate(("group", "column", "rank", "place"))},
        {"group": pa.int32(), "column": pa.string(), "rank": pa.int64(), "place": pa.int64()},
    )
    hits = (
        counted.withColumn("upto", upto)
        .join(F.broadcast(ranks), "group")
        .where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        .select("column", "rank", "value")
        .collect()
    )
    return {(h["column"], h["rank"]): h["value"] for h in hits}
