"""Reading, profile detection, casting, validation and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.functions.casting import cast_feature, inf_to_zero
from flowward.functions.ips import is_valid_ip
from flowward.operators.features import (
    detect_profile_col,
    downcast,
    extract,
    extract_messages,
    extract_with_profile,
    hit_count,
    pack_features,
    project,
    unpack_features,
)
from flowward.operators.scoring import rule_attack_class, rule_threat_score
from flowward.operators.validation import DROP, drop_invalid, validate, with_errors
from flowward.plans.catalog.registry import quoted, query
from flowward.plans.pipeline import score_frame
from flowward.profiles import ATTACK_PROFILE, THREAT_CURRENT, THREAT_LEGACY
from flowward.session import scratch_path
from flowward.sources import flow_views as V
from flowward.sources.flow_files import read_flows_csv, read_many_csv, with_dense_ids
from flowward.sources.tables import (
    append_log_csv,
    load_table,
    prediction_structs,
    to_prediction_messages,
    write_csv,
    write_flows_json,
    write_scored,
)

_LEGACY = ", ".join(f'"{c}"' for c in THREAT_LEGACY.columns)
_CURRENT = ", ".join(f'"{c}"' for c in THREAT_CURRENT.columns)
_ATTACK = ", ".join(ATTACK_PROFILE.columns)


def with_file_names(flows):
    """Attack-profile flows under the names that files use."""
    return flows.select("id", *[F.col(c).alias(f) for f, c in zip(ATTACK_PROFILE.features, ATTACK_PROFILE.columns)])


# -- files ---------------------------------------------------------------------


@query(f"SELECT id, {_LEGACY} FROM flow10")
def csv_threat_flows(spark, sf_dir):
    """All threat flows written as CSV and read back through detection and casting."""
    path = scratch_path(spark, "flows") + ".csv"
    write_csv(V.flow10(spark, sf_dir).select("id", *THREAT_LEGACY.features), path)
    typed, profile = extract(read_flows_csv(spark, path), keep=["id"])
    return typed.select(F.col("id").cast("bigint").alias("id"), *profile.columns)


@query(f"SELECT id, {_ATTACK} FROM flow42")
def csv_attack_flows(spark, sf_dir):
    """All attack flows written as CSV in two files and read back as one."""
    path = scratch_path(spark, "flows")
    flows = with_file_names(V.flow42(spark, sf_dir))
    late = F.col("` Flow Duration`") > 100000
    for name, part in (("late", flows.where(late)), ("early", flows.where(~late))):
        write_csv(part, f"{path}-{name}.csv")
    raw = read_many_csv(spark, [f"{path}-late.csv", f"{path}-early.csv"])
    typed, profile = extract(raw, keep=["id"])
    return typed.select(F.col("id").cast("bigint").alias("id"), *profile.columns)


@query(
    """SELECT src_bytes, dst_bytes, "count", prediction_score, is_attack, 'upload' AS source, 'upload-all' AS batch_id
    FROM threat JOIN flow10 USING (id)"""
)
def scored_upload(spark, sf_dir):
    """The upload pipeline from a raw frame to scored rows; ids are given anew."""
    raw = V.flow10(spark, sf_dir).select("id", *THREAT_LEGACY.features)
    scored = score_frame(raw, policy=DROP, batch_id="upload-all").scored
    return scored.select("src_bytes", "dst_bytes", "count", "prediction_score", "is_attack", "source", "batch_id")


@query(
    """SELECT t.id, t.traffic_data_id, t.created_at, t.prediction_score, t.is_attack, m.source
    FROM threat t JOIN messages m ON m.id = t.id WHERE m.source = 'external_kafka'"""
)
def stored_external_threats(spark, sf_dir):
    """Scored rows written to the result tables; one source read back."""
    root = scratch_path(spark, "tables")
    flows = V.as_view(V.events(spark, sf_dir), V.FLOW10 | {k: v for k, v in V.MESSAGES.items() if k != "id"})
    write_scored(rule_threat_score(flows), THREAT_LEGACY, root, "load")
    stored = load_table(spark, "threat_predictions", root).where(F.col("source") == "external_kafka")
    return stored.select("id", "traffic_data_id", "created_at", "prediction_score", "is_attack", "source")


@query(
    """SELECT a.id, a.attack_type_name, a.confidence, x.action_type, x.action_description, x.pvalue AS param_value,
    42 AS features FROM attack a JOIN action x ON x.attack_prediction_id = a.id"""
)
def stored_attack_tables(spark, sf_dir):
    """Attack rows written to the linked tables and joined back together."""
    root = scratch_path(spark, "tables")
    flows = V.flow42(spark, sf_dir).withColumns({"source": F.lit("upload"), "batch_id": F.lit("orders")})
    write_scored(rule_attack_class(flows), ATTACK_PROFILE, root, "load")
    traffic = load_table(spark, "traffic_data", root).select("id", F.size("features").alias("features"))
    attack = load_table(spark, "attack_predictions", root).select(
        "id", F.col("traffic_data_id").alias("t"), "attack_type_name", "confidence"
    )
    action = load_table(spark, "self_healing_actions", root).select(
        F.col("attack_prediction_id").alias("id"),
        "action_type",
        "action_description",
        F.get(F.map_values("action_params"), F.lit(0)).alias("param_value"),
    )
    return attack.join(action, "id").join(traffic.withColumnRenamed("id", "t"), "t").drop("t")


@query(
    """SELECT t.id AS traffic_data_id, 'prediction' AS type, t.is_attack AS is_attack, CAST(NULL AS VARCHAR) AS attack_type,
    CAST(NULL AS VARCHAR) AS action_type, strftime(t.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM threat t
    UNION ALL SELECT a.id, 'prediction', NULL, a.attack_type_name, x.action_type,
    strftime(a.created_at, '%Y-%m-%dT%H:%M:%S.%f') FROM attack a JOIN action x ON x.attack_prediction_id = a.id"""
)
def prediction_messages(spark, sf_dir):
    """JSON prediction messages of both record types, read back field by field."""
    threats = prediction_structs(rule_threat_score(V.flow10(spark, sf_dir)), THREAT_LEGACY)
    attacks = prediction_structs(rule_attack_class(V.flow42(spark, sf_dir)), ATTACK_PROFILE)
    value = to_prediction_messages(threats.unionByName(attacks)).select(
        F.from_json(
            "value",
            "type string, timestamp string, data struct<traffic_data_id:bigint, threat_prediction:struct<is_attack:boolean>,"
            " attack_prediction:struct<attack_type_name:string>, self_healing_action:struct<action_type:string>>",
        ).alias("m")
    )
    return value.select(
        F.col("m.data.traffic_data_id").alias("traffic_data_id"),
        F.col("m.type").alias("type"),
        F.col("m.data.threat_prediction.is_attack").alias("is_attack"),
        F.col("m.data.attack_prediction.attack_type_name").alias("attack_type"),
        F.col("m.data.self_healing_action.action_type").alias("action_type"),
        F.col("m.timestamp").alias("at"),
    )


@query(f"SELECT id, {_LEGACY} FROM flow10")
def json_flow_lines(spark, sf_dir):
    """All threat flows published as JSON lines and read back."""
    path = scratch_path(spark, "json")
    write_flows_json(V.flow10(spark, sf_dir).select("id", *THREAT_LEGACY.features), "text", path=path)
    payload = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("payload"))
    rows = extract_messages(payload, THREAT_LEGACY)
    return rows.select(F.col("payload")["id"].cast("bigint").alias("id"), *THREAT_LEGACY.columns)


@query(f"SELECT id, {_LEGACY}, prediction_score, is_attack FROM threat JOIN flow10 USING (id)")
def csv_prediction_log(spark, sf_dir):
    """Features and prediction appended to a CSV log and read back."""
    path = scratch_path(spark, "log")
    scored = rule_threat_score(V.flow10(spark, sf_dir))
    append_log_csv(scored.select("id", *THREAT_LEGACY.columns, "prediction_score", "is_attack"), path)
    schema = ", ".join(["id bigint", *[f"{c} double" for c in THREAT_LEGACY.columns], "prediction_score double, is_attack boolean"])
    return spark.read.schema(schema).csv(path, header=True)


@query("SELECT count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT event_id) AS ids FROM events")
def assigned_ids(spark, sf_dir):
    """Ids handed out to all rows: dense from 0, none twice."""
    numbered = with_dense_ids(V.read_table(spark, sf_dir, "events").select("ts", "value"))
    return numbered.agg(
        F.count("*").alias("rows"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count_distinct("id").alias("ids"),
    )


# -- projection and detection --------------------------------------------------------


@query(f"SELECT id, {_CURRENT} FROM flow10")
def current_profile_features(spark, sf_dir):
    return project(V.flow10(spark, sf_dir), THREAT_CURRENT, keep=["id"])


@query(f"SELECT id, {_ATTACK} FROM flow42")
def loosely_named_columns(spark, sf_dir):
    """Columns whose names differ from the profile in case and outer blanks."""
    flows = with_file_names(V.flow42(spark, sf_dir))
    other = [F.col("id")] + [
        F.col(f"`{f}`").alias(f.strip().upper() if i % 3 else f"{f}  ") for i, f in enumerate(ATTACK_PROFILE.features)
    ]
    rows = extract_with_profile(flows.select(*other), ATTACK_PROFILE, keep=["id"])
    return rows.select("id", *ATTACK_PROFILE.columns)


@query(f"SELECT id, {_ATTACK}, 0 AS errors FROM flow42")
def loosely_named_messages(spark, sf_dir):
    """The same for key-value messages: seven keys have lost their leading blank."""
    packed = pack_features(V.flow42(spark, sf_dir), ATTACK_PROFILE)
    leading = [f for f in ATTACK_PROFILE.features if f.startswith(" ")][:7]
    payload = F.transform_keys("features", lambda k, _: F.when(k.isin(leading), F.upper(F.trim(k))).otherwise(k))
    texts = packed.select("id", F.transform_values(payload, lambda _, v: v.cast("string")).alias("payload"))
    rows = extract_messages(texts, ATTACK_PROFILE)
    return rows.select("id", *ATTACK_PROFILE.columns, F.size("errors").alias("errors"))


def kept_keys(event_type):
    """Per event type the keys that a message of that type carries."""
    both = sorted(set(THREAT_CURRENT.features) | set(THREAT_LEGACY.features))
    keys = {
        "click": both,
        "error": list(THREAT_LEGACY.features),
        "purchase": list(THREAT_CURRENT.features),
        "signup": list(THREAT_LEGACY.features[:8]),
    }
    out = F.array(*[F.lit(f) for f in THREAT_CURRENT.features[:7]])
    for kind, names in keys.items():
        out = F.when(event_type == kind, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def _hits(kind: str, profile) -> int:
    sets = {
        "click": set(THREAT_CURRENT.features) | set(THREAT_LEGACY.features),
        "error": set(THREAT_LEGACY.features),
        "purchase": set(THREAT_CURRENT.features),
        "signup": set(THREAT_LEGACY.features[:8]),
        "view": set(THREAT_CURRENT.features[:7]),
    }
    return len(sets[kind] & set(profile.features))


def _hit_sql(profile) -> str:
    kinds = ("click", "error", "purchase", "signup", "view")
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {_hits(k, profile)}" for k in kinds) + " END"


@query(
    f"""SELECT event_id AS id, 'event' AS kind, CASE event_type WHEN 'click' THEN 'threat_current'
    WHEN 'error' THEN 'threat_legacy' WHEN 'purchase' THEN 'threat_current' WHEN 'signup' THEN 'threat_legacy' END
    AS profile, {_hit_sql(THREAT_CURRENT)} AS current_hits, {_hit_sql(THREAT_LEGACY)} AS legacy_hits FROM events
    UNION ALL SELECT o_orderkey, 'order', 'attack', 0, 0 FROM orders"""
)
def detected_profiles(spark, sf_dir):
    """The profile of every message, by the keys it carries."""
    events = V.read_table(spark, sf_dir, "events")
    payloads = events.select(
        F.col("event_id").alias("id"),
        F.lit("event").alias("kind"),
        F.map_from_entries(F.transform(kept_keys(F.col("event_type")), lambda k: F.struct(k, F.lit("1")))).alias("payload"),
    )
    orders = pack_features(V.flow42(spark, sf_dir), ATTACK_PROFILE).select(
        "id", F.lit("order").alias("kind"), F.transform_values("features", lambda _, v: v.cast("string")).alias("payload")
    )
    keys = F.map_keys("payload")
    return payloads.unionByName(orders).select(
        "id",
        "kind",
        detect_profile_col(F.col("payload")).alias("profile"),
        hit_count(keys, THREAT_CURRENT).alias("current_hits"),
        hit_count(keys, THREAT_LEGACY).alias("legacy_hits"),
    )


@query(
    """SELECT event_id AS id, CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN 1000 WHEN 'signup' THEN 12.5
    WHEN 'view' THEN 0 END AS number, event_type = 'error' AS invalid FROM events"""
)
def parsed_numbers(spark, sf_dir):
    """Texts of several kinds as feature values: plain, grouped digits, padded, infinite and not numeric."""
    text = (
        F.when(F.col("event_type") == "click", F.col("value").cast("string"))
        .when(F.col("event_type") == "purchase", "1_000")
        .when(F.col("event_type") == "signup", "\t12.5 ")
        .when(F.col("event_type") == "view", "-Infinity")
        .otherwise(F.col("props"))
    )
    parsed = V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), cast_feature(text).alias("number"))
    return parsed.select("id", inf_to_zero(F.col("number")).alias("number"), F.col("number").isNull().alias("invalid"))


@query("SELECT id, 10 AS features, src_bytes, diff_srv_rate FROM flow10")
def packed_features(spark, sf_dir):
    """Feature columns into the stored map and back."""
    packed = pack_features(V.flow10(spark, sf_dir), THREAT_LEGACY).select("id", "features")
    return unpack_features(packed, THREAT_LEGACY).select(
        "id", F.size("features").alias("features"), "src_bytes", "diff_srv_rate"
    )


@query(
    """SELECT o_orderkey, CAST(CASE WHEN big % 4294967296 >= 2147483648 THEN big % 4294967296 - 4294967296
    ELSE big % 4294967296 END AS INTEGER) AS big, CAST(CAST(o_totalprice AS REAL) AS DOUBLE) AS price
    FROM (SELECT *, o_orderkey * 3000000 AS big FROM orders)"""
)
def downcast_columns(spark, sf_dir):
    orders = V.read_table(spark, sf_dir, "orders")
    wide = orders.select("o_orderkey", (F.col("o_orderkey") * 3000000).alias("big"), F.col("o_totalprice").alias("price"))
    return downcast(wide, ["big", "price"]).withColumn("price", F.col("price").cast("double"))


# -- validation ------------------------------------------------------------------------

_RATES = ["same_srv_rate", "diff_srv_rate", "dst_host_same_srv_rate", "dst_host_same_src_port_rate"]


def dirty_threat_flows(spark, sf_dir):
    """Threat flows of which some event types break a rule."""
    flows = V.flow10(spark, sf_dir)
    kind = F.col("flag")
    return flows.withColumns(
        {
            "diff_srv_rate": F.when(kind == 1, F.col("diff_srv_rate") + 0.5).otherwise(F.col("diff_srv_rate")),
            "same_srv_rate": F.when(kind == 2, F.lit(float("nan"))).otherwise(F.col("same_srv_rate")),
            "src_bytes": F.when(kind == 3, F.lit(float("nan"))).otherwise(F.col("src_bytes")),
            "count": F.when(kind == 4, F.col("count") - 256).otherwise(F.col("count")),
        }
    )


_DIRTY10 = """SELECT id, flag, CASE WHEN flag = 1 THEN diff_srv_rate + CAST(0.5 AS DOUBLE) ELSE diff_srv_rate END AS diff,
    flag = 2 AS nan_rate, CASE WHEN flag = 4 THEN "count" - 256 ELSE "count" END AS cnt FROM flow10"""


@query(
    f"""SELECT id, CAST(diff > 1 AS INTEGER) + CAST(nan_rate AS INTEGER) + CAST(cnt < 0 AS INTEGER) AS errors,
    NOT (diff > 1 OR nan_rate OR cnt < 0) AS valid FROM ({_DIRTY10})"""
)
def threat_validation(spark, sf_dir):
    checked = with_errors(dirty_threat_flows(spark, sf_dir), THREAT_LEGACY)
    return checked.select("id", F.size("errors").alias("errors"), "valid")


@query(
    f"""SELECT error, count(*) AS "count" FROM (
    SELECT 'Feature ''diff_srv_rate'' must be between 0 and 1' AS error FROM ({_DIRTY10}) WHERE diff > 1
    UNION ALL SELECT 'Feature ''same_srv_rate'' must be between 0 and 1' FROM ({_DIRTY10}) WHERE nan_rate
    UNION ALL SELECT 'Feature ''count'' must be non-negative' FROM ({_DIRTY10}) WHERE cnt < 0) GROUP BY 1"""
)
def quarantine_reasons(spark, sf_dir):
    """Rows set aside by the DROP policy, counted by error."""
    _, bad = validate(dirty_threat_flows(spark, sf_dir), THREAT_LEGACY, DROP)
    return bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("count"))


@query(f"SELECT count(*) AS valid_rows FROM ({_DIRTY10}) WHERE NOT (diff > 1 OR nan_rate OR cnt < 0)")
def rows_kept_by_drop_policy(spark, sf_dir):
    good, _ = validate(dirty_threat_flows(spark, sf_dir), THREAT_LEGACY, DROP)
    return good.agg(F.count("*").alias("valid_rows"))


_PORT_ERROR = quoted("Destination Port must be between 0 and 65535")
_DIRTY42 = """SELECT id, CASE WHEN destination_port = 110 THEN 65536 WHEN destination_port = 143 THEN -1
    WHEN destination_port = 25 THEN CAST('NaN' AS DOUBLE) ELSE destination_port END AS port,
    flow_iat_mean - 1500 AS iat, down_up_ratio - 5000 AS ratio FROM flow42"""


@query(
    f"""SELECT id, CAST(NOT (port BETWEEN 0 AND 65535) AS INTEGER) + CAST(iat < -1000 AS INTEGER) AS errors,
    CASE WHEN NOT (port BETWEEN 0 AND 65535) THEN {_PORT_ERROR}
    WHEN iat < -1000 THEN 'Feature '' Flow IAT Mean'' has unrealistic negative value' END AS first_error
    FROM ({_DIRTY42})"""
)
def attack_validation(spark, sf_dir):
    port = F.col("destination_port")
    dirty = V.flow42(spark, sf_dir).withColumns(
        {
            "destination_port": F.when(port == 110, 65536.0)
            .when(port == 143, -1.0)
            .when(port == 25, float("nan"))
            .otherwise(port),
            "flow_iat_mean": F.col("flow_iat_mean") - 1500,
            "down_up_ratio": F.col("down_up_ratio") - 5000,
        }
    )
    checked = with_errors(dirty, ATTACK_PROFILE)
    return checked.select("id", F.size("errors").alias("errors"), F.get("errors", F.lit(0)).alias("first_error"))


@query(
    """SELECT event_id AS id, value FROM events WHERE event_type NOT IN ('error', 'signup', 'view')"""
)
def finite_rows(spark, sf_dir):
    """Rows left after dropping nulls, NaN and infinities."""
    kind = F.col("event_type")
    value = (
        F.when(kind == "error", F.lit(None))
        .when(kind == "signup", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    rows = V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), value.alias("value"))
    return drop_invalid(rows)


@query(
    """SELECT event_id AS id, event_type IN ('click', 'purchase') OR (event_type = 'signup' AND user_id % 300 < 256)
    AS valid FROM events"""
)
def valid_addresses(spark, sf_dir):
    """Addresses of several spellings: IPv4, IPv6, an octet that may be too large, a leading zero, a name."""
    kind, user = F.col("event_type"), F.col("user_id")
    octet = (user % 300).cast("string")
    text = (
        F.when(kind == "click", F.concat(F.lit("10.1.2."), (user % 256).cast("string")))
        .when(kind == "purchase", F.concat(F.lit("2001:db8::"), F.lower(F.hex(user % 65536))))
        .when(kind == "signup", F.concat(F.lit("192.168.7."), octet))
        .when(kind == "error", F.concat(F.lit("10.01.2."), (user % 256).cast("string")))
        .otherwise(F.concat(F.lit("host-"), octet))
    )
    return V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), is_valid_ip(text).alias("valid"))
