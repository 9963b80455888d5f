"""From raw columns or key-value maps to typed feature columns.

Files are resolved once per schema (`detect_profile`, `extract`); messages are
resolved per row (`detect_profile_col`, `extract_messages`). Both give the same
columns: the profile's snake-case names as doubles plus ``errors``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowward.functions.casting import cast_csv_cell, cast_feature, inf_to_zero, strip
from flowward.profiles import (
    ATTACK,
    ATTACK_MIN_HITS,
    BUILTIN_PROFILES,
    THREAT,
    THREAT_MIN_HITS,
    FeatureProfile,
)


class FeatureError(ValueError):
    """The input does not carry the features a profile asks for.

    The wording of these errors is a fixed value: clients show and match it.
    """


# -- names ---------------------------------------------------------------


def _loose(name: str) -> str:
    return name.strip().lower()


def resolve_columns(cols: Sequence[str], profile: FeatureProfile) -> dict[str, str | None]:
    """Feature name -> column that carries it: the exact name, else the first equal one ignoring case and outer space."""
    loose: dict[str, str] = {}
    for col in cols:
        loose.setdefault(_loose(col), col)
    exact = set(cols)
    return {
        f: f if f in exact else (loose.get(_loose(f)) if profile.fuzzy else None) for f in profile.features
    }


def missing_names(keys: Iterable[str], profile: FeatureProfile) -> list[str]:
    """Profile features that are not among ``keys`` (exact names)."""
    have = set(keys)
    return [f for f in profile.features if f not in have]


def extra_names(keys: Iterable[str], profile: FeatureProfile) -> list[str]:
    """Keys that are not profile features (exact names, so a loosely matched column counts)."""
    want = set(profile.features)
    return [k for k in keys if k not in want]


def hit_count(keys: Iterable[str] | Column, profile: FeatureProfile) -> int | Column:
    """How many profile features occur by exact name; ``keys`` is a name list or an array column."""
    if isinstance(keys, Column):
        return F.size(F.array_intersect(keys, _names(profile)))
    have = set(keys)
    return sum(f in have for f in profile.features)


def missing_names_col(keys: Column, profile: FeatureProfile) -> Column:
    return F.array_except(_names(profile), keys)


def extra_names_col(keys: Column, profile: FeatureProfile) -> Column:
    return F.array_except(keys, _names(profile))


def _names(profile: FeatureProfile) -> Column:
    return F.array(*[F.lit(f) for f in profile.features])


# -- detection -------------------------------------------------------------


def _of_type(profiles: Sequence[FeatureProfile], model_type: str) -> list[FeatureProfile]:
    return [p for p in profiles if p.model_type == model_type]


def detect_profile(cols: Sequence[str], profiles: Sequence[FeatureProfile] = BUILTIN_PROFILES) -> FeatureProfile:
    """The profile of a schema: enough attack names make it an attack schema, else enough threat names a threat one.

    Several profiles of one type: the one with most hits, the first on a tie.
    """
    best = {
        t: max(_of_type(profiles, t), key=lambda p: hit_count(cols, p), default=None) for t in (ATTACK, THREAT)
    }
    hits = {t: hit_count(cols, p) if p else 0 for t, p in best.items()}
    if hits[ATTACK] >= ATTACK_MIN_HITS:
        return best[ATTACK]
    if hits[THREAT] >= THREAT_MIN_HITS:
        return best[THREAT]
    raise FeatureError(
        f"Cannot detect the record type: {hits[THREAT]} threat and {hits[ATTACK]} attack feature names found"
    )


def detect_profile_col(m: Column, profiles: Sequence[FeatureProfile] = BUILTIN_PROFILES) -> Column:
    """Per row: the name of the profile that the map's keys follow, or null."""
    keys = F.map_keys(m)

    def best(model_type: str, least: int) -> tuple[Column, Column]:
        options = _of_type(profiles, model_type)
        if not options:
            return F.lit(False), F.lit(None).cast("string")
        hits = [hit_count(keys, p) for p in options]
        top = F.greatest(*hits) if len(hits) > 1 else hits[0]
        name = F.lit(options[-1].name)
        for p, h in reversed(list(zip(options, hits))[:-1]):
            name = F.when(h == top, p.name).otherwise(name)
        return top >= least, name

    is_attack, attack_name = best(ATTACK, ATTACK_MIN_HITS)
    is_threat, threat_name = best(THREAT, THREAT_MIN_HITS)
    return F.when(is_attack, attack_name).when(is_threat, threat_name)


# -- extraction --------------------------------------------------------------


def project(df: DataFrame, profile: FeatureProfile, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the profile's feature columns in order, after the columns to keep."""
    return df.select(*keep, *profile.columns)


def check_required(df: DataFrame, profile: FeatureProfile) -> dict[str, str]:
    """Feature -> column for every feature; raises with the names that are not there."""
    found = resolve_columns(df.columns, profile)
    missing = [f for f, c in found.items() if c is None]
    if missing:
        raise FeatureError(
            f"Missing required features: {', '.join(missing)}. "
            f"Expected {len(profile.features)} features, found {len(df.columns)} columns."
        )
    return found


def _typed(df: DataFrame, profile: FeatureProfile, keep: Sequence[str]) -> DataFrame:
    """``_values`` (array of doubles in profile order) as one column per feature, after the columns to keep."""
    return df.select(
        *keep, *[F.get("_values", F.lit(i)).alias(c) for i, c in enumerate(profile.columns)], "errors"
    )


def _parsed(raw: Column, parse: Callable[[Column], Column], profile: FeatureProfile) -> Column:
    """All raw texts of a row as doubles. One expression over an array: it stays small for wide profiles."""
    numbers = F.transform(raw, parse)
    return F.transform(numbers, inf_to_zero) if profile.fuzzy else numbers


def _invalid(feature: Column) -> Column:
    return F.concat(F.lit("Invalid value for feature '"), feature, F.lit("': expected a number"))


def extract_with_profile(
    df: DataFrame, profile: FeatureProfile, allow_extra: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Typed feature columns of a text frame, plus ``errors`` for cells that are not numeric.

    ``keep`` names the columns that pass through and do not count as extra.
    """
    found = check_required(df, profile)
    extra = extra_names([c for c in df.columns if c not in keep], profile)
    if extra and not allow_extra:
        raise FeatureError(f"Unexpected columns found: {', '.join(extra)}")
    kept = [f"`{k}`" for k in keep]
    cells = F.array(*[F.col(f"`{found[f]}`").cast("string") for f in profile.features])
    rows = df.select(*kept, _parsed(cells, cast_csv_cell, profile).alias("_values"))
    errors = F.transform(_names(profile), lambda f, i: F.when(F.get("_values", i).isNull(), _invalid(f)))
    return _typed(rows.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())), profile, kept)


def extract(
    df: DataFrame,
    model_type: str = "auto",
    profiles: Sequence[FeatureProfile] = BUILTIN_PROFILES,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, FeatureProfile]:
    """Typed features of a text frame and the profile used.

    ``model_type`` is ``auto``, a record type or a profile name.
    """
    if model_type == "auto":
        profile = detect_profile(df.columns, profiles)
    else:
        named = [p for p in profiles if p.name == model_type] or _of_type(profiles, model_type)
        if not named:
            raise FeatureError(f"Invalid model type: {model_type}")
        profile = max(named, key=lambda p: hit_count(df.columns, p))
    return extract_with_profile(df, profile, keep=keep), profile


def message_values(
    df: DataFrame, profiles: Sequence[FeatureProfile], map_col: str = "payload", profile_col: str = "profile"
) -> DataFrame:
    """Add ``_values`` (doubles in the order of the row's profile) and ``errors`` (missing or not numeric).

    An exact key wins over a loosely equal one; keys are compared loosely only in
    rows that lack an exact one. The exact ones are read by one pass over the
    map as JSON, which is far cheaper than a search of the map per feature.
    Store the result before filtering on it: a filter that Spark moves below
    these steps would repeat them.
    """
    m = F.col(map_col)
    steps: list[dict[str, Column]] = [{}, {}, {}, {}]
    for p_index, profile in enumerate(profiles):
        own = F.col(profile_col) == profile.name
        row, others, exact, values, errors = (f"_{n}{p_index}" for n in ("row", "others", "exact", "values", "errors"))
        steps[0][row] = F.when(own, F.from_json(F.to_json(m), StructType([StructField(f, StringType()) for f in profile.features])))
        steps[0][others] = _other_entries(m, profile, own)
        steps[1][exact] = F.expr(f"array({row}.*)")
        steps[2][values] = F.when(own, _parsed(_raw_texts(m, profile, exact, others), cast_feature, profile))
        steps[3][errors] = F.when(own, _value_errors(m, profile, values, others))
    out = df
    for step in steps:
        out = out.withColumns(step)
    count = range(len(profiles))
    return out.select(
        *[f"`{c}`" for c in df.columns],
        F.coalesce(*[F.col(f"_values{i}") for i in count]).alias("_values"),
        F.coalesce(*[F.col(f"_errors{i}") for i in count]).alias("errors"),
    )


def _name_pairs(profile: FeatureProfile) -> Column:
    """One literal: a call to the JVM for each name would take longer than a small micro-batch."""
    pairs = json.dumps([{"exact": f, "loose": _loose(f)} for f in profile.features])
    return F.from_json(F.lit(pairs), "array<struct<exact:string,loose:string>>")


def _other_entries(m: Column, profile: FeatureProfile, own: Column) -> Column:
    """The map's entries under stripped lower-case keys, empty where no loose lookup is needed."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    if not profile.fuzzy:
        return none
    entries = F.transform(
        F.map_entries(m), lambda e: F.struct(F.lower(strip(e["key"])).alias("k"), e["value"].alias("v"))
    )
    lacking = F.size(missing_names_col(F.map_keys(m), profile)) > 0
    return F.when(own & lacking, entries).otherwise(none)


def _raw_texts(m: Column, profile: FeatureProfile, exact: str, others: str) -> Column:
    if not profile.fuzzy:
        return F.col(exact)

    def pick(name: Column, i: Column) -> Column:
        near = F.get(F.filter(others, lambda e: e["k"] == name["loose"]), F.lit(0))["v"]
        return F.when(F.map_contains_key(m, name["exact"]), F.get(exact, i)).otherwise(near)

    return F.when(F.size(others) == 0, F.col(exact)).otherwise(F.transform(_name_pairs(profile), pick))


def _value_errors(m: Column, profile: FeatureProfile, values: str, others: str) -> Column:
    def error(name: Column, i: Column) -> Column:
        found = F.map_contains_key(m, name["exact"]) | F.exists(others, lambda e: e["k"] == name["loose"])
        missing = F.concat(F.lit("Missing required feature: "), name["exact"])
        return F.when(F.get(values, i).isNull(), F.when(found, _invalid(name["exact"])).otherwise(missing))

    return F.filter(F.transform(_name_pairs(profile), error), lambda e: e.isNotNull())


def value_columns(df: DataFrame, profile: FeatureProfile) -> DataFrame:
    """``_values`` of one profile's rows as feature columns."""
    kept = [f"`{c}`" for c in df.columns if c not in ("_values", "errors")]
    return _typed(df, profile, kept)


def extract_messages(df: DataFrame, profile: FeatureProfile, map_col: str = "payload") -> DataFrame:
    """Rows of one profile: its feature columns out of a string map, plus ``errors``."""
    marked = df.withColumn("_profile", F.lit(profile.name))
    return value_columns(message_values(marked, [profile], map_col, "_profile").drop("_profile"), profile)


# -- packing -------------------------------------------------------------------


def pack_features(df: DataFrame, profile: FeatureProfile, name: str = "features") -> DataFrame:
    """Add the feature columns as one ``map<string,double>`` under the profile's own names."""
    return df.withColumn(
        name, F.map_from_arrays(_names(profile), F.array(*[F.col(c) for c in profile.columns]))
    )


def unpack_features(df: DataFrame, profile: FeatureProfile, name: str = "features") -> DataFrame:
    """The reverse of `pack_features`; a feature the map lacks comes out null."""
    return df.withColumns({c: F.col(name)[f] for f, c in zip(profile.features, profile.columns)})


def downcast(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """bigint to int and double to float; a bigint outside the int range wraps around as 32-bit storage does."""
    types = dict(df.dtypes)
    changes = {}
    for c in cols or df.columns:
        if types[c] == "bigint":
            low = F.pmod(F.col(c), F.lit(2**32))
            changes[c] = F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")
        elif types[c] == "double":
            changes[c] = F.col(c).cast("float")
    return df.withColumns(changes) if changes else df


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns that are there, e.g. the constant ``num_outbound_cmds``."""
    return df.drop(*names)
