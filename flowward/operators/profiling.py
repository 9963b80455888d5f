"""Data profiling: counts, summaries, duplicates and correlations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from flowward.operators.quantiles import quantiles_and
from flowward.operators.validation import drop_invalid
from flowward.profiles import fixed_table

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.groupBy(F.col(f"`{col}`").alias("value")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value")
    )


def column_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column; quartiles are exact."""
    cols = list(cols or numeric_columns(df))
    values = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    stats = [f(v) for v in values.values() for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    quartiles, row = quantiles_and(df, cols, QUARTILES, stats)
    out = []
    for i, c in enumerate(values):
        count, mean, std, least, most = row[5 * i : 5 * i + 5]
        if count:
            out.append((c, count, mean, std, least, *[quartiles[(c, p)] for p in QUARTILES], most))
    names = ("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    types = dict.fromkeys(names, pa.float64()) | {"column": pa.string(), "count": pa.int64()}
    return fixed_table(df.sparkSession, {k: [o[i] for o in out] for i, k in enumerate(names)}, types)


def column_types(df: DataFrame) -> DataFrame:
    """Place, name, type and number of non-null values of every column, as a listing of a table's structure."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")) for c in df.columns]).first()
    return fixed_table(
        df.sparkSession,
        {"place": list(range(len(df.columns))), "column": df.columns, "dtype": [t for _, t in df.dtypes], "non_null": list(counts)},
        {"place": pa.int32(), "column": pa.string(), "dtype": pa.string(), "non_null": pa.int64()},
    )


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def head(df: DataFrame, by: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` first rows in the order of ``by``; every task keeps its own ``n`` first."""
    return df.orderBy(*by).limit(n)


def text_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, number of distinct values, most frequent value and its count per text column."""
    cols = list(cols or text_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols])
    per_value = (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    # Least of (-count, value): the top count, and of several the smallest value.
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("top")
    return (
        per_value.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count("*").alias("unique"), top)
        .select("column", "count", "unique", F.col("top.value").alias("top"), (-F.col("top.neg")).alias("freq"))
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column."""
    one_row = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns]
    )
    return one_row.select(F.inline(pairs))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def dedup(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    return df.dropDuplicates()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(f"`{col}`").alias("value")).distinct()


def correlation_values(df: DataFrame, cols: Sequence[str]) -> list[list[float]]:
    """Pearson correlation of complete rows as a square list; NaN where a column is constant.

    MLlib adds up one d x d matrix per task and merges them as a tree; the driver
    holds only that matrix.
    """
    rows = drop_invalid(df.select(*cols), list(cols))
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_vector").transform(rows).select("_vector")
    return Correlation.corr(vectors, "_vector").first()[0].toArray().tolist()


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) for every pair of numeric columns; null where undefined."""
    cols = list(cols or numeric_columns(df))
    values = correlation_values(df, cols)
    cells = [
        (a, b, values[i][j] if values[i][j] == values[i][j] else None)
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return fixed_table(
        df.sparkSession,
        {k: [c[i] for c in cells] for i, k in enumerate(("column_a", "column_b", "correlation"))},
        {"column_a": pa.string(), "column_b": pa.string(), "correlation": pa.float64()},
    )
