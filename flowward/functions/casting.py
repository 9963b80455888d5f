"""Turning text into feature values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cell texts that a CSV reader takes as a missing number.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
_PLAIN = r"^[+-]?[0-9]+(\.[0-9]*)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"

# Every character that counts as white space.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

INF = float("inf")
NAN = float("nan")


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def parse_number(c: Column) -> Column:
    """Text as double; null when it is not a number.

    Plain decimals, the usual case, go straight through the cast. Anything else is
    held against the full pattern first: the cast would also take forms such as
    ``5d``, while digit groups joined by ``_`` and signed words count as well.
    """
    text = strip(c)
    special = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    word = F.when(special == "nan", F.lit(NAN)).when(text.startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))
    careful = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double")).when(
        text.rlike(_SPECIAL), word
    )
    return F.when(c.rlike(_PLAIN), c.try_cast("double")).otherwise(careful)


def cast_feature(c: Column) -> Column:
    """A JSON value as double; null when absent, null or not numeric. JSON booleans count as 1 and 0."""
    return F.when(c.isin("true", "false"), (c == "true").cast("double")).otherwise(parse_number(c))


def cast_csv_cell(c: Column) -> Column:
    """A CSV cell as double: a missing cell is NaN, anything else non-numeric is null."""
    return F.when(c.isNull() | strip(c).isin(MISSING_CELLS), F.lit(NAN)).otherwise(parse_number(c))


def inf_to_zero(c: Column) -> Column:
    """Replace both infinities by 0; NaN stays."""
    return F.when(F.abs(c) == INF, F.lit(0.0)).otherwise(c)


def greater(c: Column, bound: float | Column) -> Column:
    """``c > bound``, false for NaN (Spark orders NaN above every number)."""
    return (c > bound) & ~F.isnan(c)


