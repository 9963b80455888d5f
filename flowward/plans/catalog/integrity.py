"""Uploads that repeat, run side by side or bring odd columns, and the refusals of bad files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.operators.dashboards import merged_batches, merged_threat_stats
from flowward.operators.features import (
    FeatureError,
    check_required,
    drop_columns,
    extra_names,
    extract,
    extract_messages,
    extract_with_profile,
    pack_features,
)
from flowward.operators.validation import DROP, FAILFAST, InvalidRowError, validate
from flowward.plans.catalog.ingest import dirty_threat_flows
from flowward.plans.catalog.registry import query
from flowward.plans.pipeline import score_frame, score_upload
from flowward.profiles import THREAT_CURRENT, THREAT_LEGACY
from flowward.session import scratch_path
from flowward.sources import flow_views as V
from flowward.sources.flow_files import read_flows_csv
from flowward.sources.manifest import snapshot
from flowward.sources.tables import compact_tables, load_dashboard, load_tables, write_csv

_COLUMNS = THREAT_LEGACY.columns
_LEGACY = ", ".join(f'"{c}"' for c in _COLUMNS)


def flows_csv(spark: SparkSession, sf_dir: str, *extra: F.Column, where: str = "true") -> str:
    """Threat flows as a CSV, all by default."""
    path = scratch_path(spark, "flows") + ".csv"
    write_csv(V.flow10(spark, sf_dir).where(where).select(*THREAT_LEGACY.features, *extra), path)
    return path


def stored_figures(spark: SparkSession, root: str) -> DataFrame:
    """Rows, distinct ids and summed scores of the stored threats, and the rows of traffic that belong to them."""
    tables = load_tables(spark, root)
    linked = tables["threat"].join(tables["traffic"].select(F.col("id").alias("traffic_data_id")), "traffic_data_id")
    return linked.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.round(F.sum("prediction_score"), 4).alias("score"),
    )


@query("SELECT count(*) AS rows, count(*) AS ids, round(sum(prediction_score), 4) AS score FROM threat")
def upload_with_own_ids(spark, sf_dir):
    """A file with an ``id`` column of texts: its rows get ids of ours and the store stays readable."""
    root = scratch_path(spark, "store")
    path = flows_csv(spark, sf_dir, F.concat(F.lit("row-"), F.col("id").cast("string")).alias("id"))
    score_upload(spark, path, root, policy=DROP)
    return stored_figures(spark, root)


@query("SELECT 2 * count(*) AS rows, 2 * count(*) AS ids, round(2 * sum(prediction_score), 4) AS score FROM threat")
def uploads_side_by_side(spark, sf_dir):
    """Two uploads that start together: no id is given twice."""
    root, path = scratch_path(spark, "store"), flows_csv(spark, sf_dir)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: score_upload(spark, path, root, policy=DROP), range(2)))
    return stored_figures(spark, root)


@query("SELECT count(*) AS rows, count(*) AS ids, round(sum(prediction_score), 4) AS score FROM threat")
def upload_run_again(spark, sf_dir):
    """The same batch uploaded twice, as after a failure: each row is stored once."""
    root, path = scratch_path(spark, "store"), flows_csv(spark, sf_dir)
    for _ in range(2):
        score_upload(spark, path, root, policy=DROP, batch_id="again")
    return stored_figures(spark, root)


@query(
    """SELECT count(*) FILTER (id % 3 = 0) AS rows_of_a, count(*) FILTER (id % 3 < 2) AS rows_before, count(*) AS rows_after,
    round(sum(prediction_score), 4) AS score, count(*) AS counted, count(*) FILTER (is_attack) AS attacks,
    count(*) FILTER (id % 3 = 1) AS listed, 2 AS folders FROM threat"""
)
def store_beside_compaction(spark, sf_dir):
    """A reader that opened the store before a re-run, a compaction and another load sees what it opened; names of
    batches that begin alike keep apart; the dashboards' cells count each row once."""
    root, parts = scratch_path(spark, "store"), [flows_csv(spark, sf_dir, where=f"id % 3 = {k}") for k in range(3)]
    for part, batch in zip(parts, ("a", "a-b"), strict=False):
        score_upload(spark, part, root, policy=DROP, batch_id=batch)
    before = load_tables(spark, root)["threat"]
    again = score_upload(spark, parts[0], root, policy=DROP, batch_id="a").scored
    compact_tables(spark, root)
    score_upload(spark, parts[2], root, policy=DROP, batch_id="realtime")
    after, cells = load_tables(spark, root)["threat"], load_dashboard(spark, root)["cells"]
    stats, batches = merged_threat_stats(cells), merged_batches(cells).where("batch_id = 'a-b'")
    return after.agg(
        F.lit(again.count()).alias("rows_of_a"),
        F.lit(before.count()).alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.round(F.sum("prediction_score"), 4).alias("score"),
        stats.select("total").scalar().alias("counted"),
        stats.select("attacks").scalar().alias("attacks"),
        batches.select("row_count").scalar().alias("listed"),
        F.lit(len(snapshot(spark, root).folders)).alias("folders"),
    )


@query(
    """SELECT count(*) AS rows, 1 AS batches, 36 AS length, count(*) FILTER (is_attack) AS attacks FROM threat"""
)
def upload_without_batch_id(spark, sf_dir):
    """An upload that brings no batch id gets one."""
    raw = V.flow10(spark, sf_dir).select(*THREAT_LEGACY.features)
    scored = score_frame(raw, policy=DROP).scored
    return scored.agg(
        F.count("*").alias("rows"),
        F.count_distinct("batch_id").cast("int").alias("batches"),
        F.max(F.length("batch_id")).alias("length"),
        F.count(F.when(F.col("is_attack"), 1)).alias("attacks"),
    )


# -- cells, columns and rows that are not as they should be ------------------------------


@query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE src_bytes END AS src_bytes, "count", 0 AS errors
    FROM flow10"""
)
def empty_cells(spark, sf_dir):
    """Empty cells of a CSV are NaN and no error."""
    path = scratch_path(spark, "cells") + ".csv"
    flows = V.flow10(spark, sf_dir).select("id", *THREAT_LEGACY.features)
    write_csv(flows.withColumn("src_bytes", F.when(F.col("id") % 3 != 0, F.col("src_bytes"))), path)
    typed, _ = extract(read_flows_csv(spark, path), keep=["id"])
    return typed.select(F.col("id").cast("bigint").alias("id"), "src_bytes", "count", F.size("errors").alias("errors"))


@query(
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'Missing required feature: dst_bytes' END AS error,
    CASE WHEN id % 4 = 0 THEN NULL ELSE dst_bytes END AS dst_bytes, src_bytes FROM flow10"""
)
def missing_message_features(spark, sf_dir):
    """Messages of which some lack a feature: the row says which."""
    packed = pack_features(V.flow10(spark, sf_dir), THREAT_LEGACY)
    texts = F.transform_values("features", lambda _, v: v.cast("string"))
    some = F.map_filter(texts, lambda k, _: ~((k == "dst_bytes") & (F.col("id") % 4 == 0)))
    rows = extract_messages(packed.select("id", some.alias("payload")), THREAT_LEGACY)
    return rows.select("id", F.get("errors", F.lit(0)).alias("error"), "dst_bytes", "src_bytes")


def _refusal(call) -> str:
    try:
        call()
    except (FeatureError, InvalidRowError) as e:
        return str(e)
    return "none"


@query(
    """SELECT min(event_id) AS first_id,
    'Missing required features: dst_bytes, count. Expected 10 features, found 9 columns.' AS told FROM events"""
)
def missing_columns(spark, sf_dir):
    """A table that lacks feature columns is refused by their names."""
    flows = V.flow10(spark, sf_dir).select("id", *[c for c in _COLUMNS if c not in ("dst_bytes", "count")])
    told = _refusal(lambda: check_required(flows, THREAT_LEGACY))
    return flows.agg(F.min("id").alias("first_id"), F.lit(told).alias("told"))


@query("SELECT count(*) AS rows, 'Unexpected columns found: id, note' AS told FROM events")
def unexpected_columns(spark, sf_dir):
    """Extra columns are refused where a caller asks for that, and named as such."""
    flows = V.flow10(spark, sf_dir).select("id", *_COLUMNS, F.lit(1).alias("note"))
    told = _refusal(lambda: extract_with_profile(flows, THREAT_LEGACY, allow_extra=False))
    assert extra_names(flows.columns, THREAT_LEGACY) == ["id", "note"]
    return flows.agg(F.count("*").alias("rows"), F.lit(told).alias("told"))


_FIRST_BAD = """SELECT min(id) AS id FROM flow10 WHERE flag IN (1, 2, 4) AND (flag = 2
    OR (flag = 1 AND diff_srv_rate + CAST(0.5 AS DOUBLE) > 1) OR (flag = 4 AND "count" < 256))"""


@query(
    f"""SELECT b.id AS first_bad, concat('Error processing row ', CAST((SELECT count(*) FROM flow10 f, ({_FIRST_BAD}) x
    WHERE f.id < x.id) AS VARCHAR)) AS told FROM ({_FIRST_BAD}) b"""
)
def refused_by_failfast(spark, sf_dir):
    """One bad row refuses all; the refusal names the first one's position."""
    flows = dirty_threat_flows(spark, sf_dir)
    told = _refusal(lambda: validate(flows, THREAT_LEGACY, FAILFAST)).split(":")[0]
    _, bad = validate(flows, THREAT_LEGACY, DROP)
    return bad.agg(F.min("id").alias("first_bad")).withColumn("told", F.lit(told))


@query(f"SELECT id, {_LEGACY}, 'threat_legacy' AS profile FROM flow10")
def profile_asked_for_by_name(spark, sf_dir):
    """Columns of both threat profiles: the one asked for is taken, not the one that would be detected."""
    both = dict.fromkeys([*THREAT_CURRENT.columns, *_COLUMNS])
    flows = V.flow10(spark, sf_dir).select("id", *both)
    rows, profile = extract(flows, "threat_legacy", keep=["id"])
    return rows.select("id", *_COLUMNS, F.lit(profile.name).alias("profile"))


@query(f"SELECT id, {_LEGACY} FROM flow10")
def constant_column_dropped(spark, sf_dir):
    """A column that carries nothing is dropped by name; one that is not there does no harm."""
    flows = V.flow10(spark, sf_dir).select("id", *_COLUMNS, F.lit(0).alias("num_outbound_cmds"))
    return drop_columns(flows, "num_outbound_cmds", "not_there")


_KEY_SETS = """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'service,same_srv_rate' ELSE '' END AS missing,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'extra' END AS extra FROM events"""


@query(_KEY_SETS)
def missing_and_extra_keys(spark, sf_dir):
    """Which of a profile's keys a message lacks, and which it has besides."""
    from flowward.operators.features import missing_names_col

    own = F.array(*[F.lit(f) for f in THREAT_LEGACY.features])
    keys = F.when(F.col("event_id") % 2 == 0, F.array_except(own, F.array(F.lit("service"), F.lit("same_srv_rate")))).otherwise(
        F.concat(own, F.array(F.lit("extra")))
    )
    rows = V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), keys.alias("keys"))
    return rows.select(
        "id",
        F.array_join(missing_names_col(F.col("keys"), THREAT_LEGACY), ",").alias("missing"),
        F.array_join(F.array_except("keys", own), ",").alias("extra"),
    )
