"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.operators import aggregates as A
from flowward.operators import dashboards as D
from flowward.operators import recent as R
from flowward.operators.scoring import rule_attack_class
from flowward.plans.catalog.frames import live_messages
from flowward.plans.catalog.registry import query
from flowward.sources import flow_views as V

_RATE = "round(count(*) FILTER (is_attack) * CAST(100 AS DOUBLE) / count(*), 2)"


_TOTALS = f"""SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks, count(*) FILTER (NOT is_attack) AS normal,
    {_RATE} AS attack_rate FROM threat"""


@query(_TOTALS)
def threat_totals(spark, sf_dir):
    """Merged from the cells of the loads, as a dashboard reads them."""
    return D.merged_threat_stats(V.dashboard_parts(spark, sf_dir)["cells"])


@query(_TOTALS)
def scanned_threat_totals(spark, sf_dir):
    """The same from the predictions themselves."""
    return A.threat_stats(V.result_tables(spark, sf_dir)["threat"])


_DISTRIBUTION = 'SELECT attack_type_name, count(*) AS "count" FROM attack GROUP BY 1'


@query(_DISTRIBUTION)
def attack_distribution(spark, sf_dir):
    return D.merged_distribution(V.dashboard_parts(spark, sf_dir)["cells"], "attack")


@query(_DISTRIBUTION)
def scanned_attack_distribution(spark, sf_dir):
    return A.attack_distribution(V.result_tables(spark, sf_dir)["attack"])


@query("SELECT count(*) AS total FROM attack")
def attack_distribution_total(spark, sf_dir):
    return A.distribution_total(A.attack_distribution(V.result_tables(spark, sf_dir)["attack"]))


_ACTIONS = 'SELECT action_type, count(*) AS "count" FROM action GROUP BY 1'


@query(_ACTIONS)
def action_distribution(spark, sf_dir):
    return D.merged_distribution(V.dashboard_parts(spark, sf_dir)["cells"], "action")


@query(_ACTIONS)
def scanned_action_distribution(spark, sf_dir):
    return A.action_distribution(V.result_tables(spark, sf_dir)["action"])


@query("SELECT count(*) AS total FROM action")
def action_distribution_total(spark, sf_dir):
    return A.distribution_total(A.action_distribution(V.result_tables(spark, sf_dir)["action"]))


@query(
    """SELECT l.code AS attack_type_encoded, l.label AS attack_type_name, count(a.id) AS "count" FROM labels14 l
    LEFT JOIN class42 a ON a.code = l.code GROUP BY 1, 2"""
)
def dense_distribution(spark, sf_dir):
    """Predictions of all flows over all 14 classes, zeros included."""
    return A.dense_distribution(rule_attack_class(V.flow42(spark, sf_dir)))


@query(
    """SELECT l.code AS attack_type_encoded, l.label AS attack_type_name, count(c.code) AS "count" FROM labels14 l
    LEFT JOIN (SELECT * FROM class42 WHERE flow_duration < 1000) c ON c.code = l.code GROUP BY 1, 2"""
)
def dense_distribution_of_short_flows(spark, sf_dir):
    """The same for short flows only: classes without a prediction come with a zero."""
    short = V.flow42(spark, sf_dir).where(F.col("flow_duration") < 1000)
    return A.dense_distribution(rule_attack_class(short))


_STATS = f"""SELECT (SELECT count(*) FROM threat) AS total, (SELECT count(*) FROM threat WHERE is_attack) AS attacks,
    (SELECT {_RATE} FROM threat) AS attack_rate,
    (SELECT string_agg(concat(attack_type_name, '=', CAST(n AS VARCHAR)), ';' ORDER BY attack_type_name)
     FROM (SELECT attack_type_name, count(*) AS n FROM attack GROUP BY 1)) AS distribution,
    (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC)
     FROM (SELECT * FROM threat ORDER BY created_at DESC, id DESC LIMIT 20)) AS recent_ids"""


@query(_STATS)
def prediction_stats(spark, sf_dir):
    """The whole stats page as one row; the lists it folds have 14 and 20 entries at most."""
    return _stats_page(D.merged_stats(V.dashboard_parts(spark, sf_dir), V.result_tables(spark, sf_dir)))


@query(_STATS)
def scanned_prediction_stats(spark, sf_dir):
    return _stats_page(A.prediction_stats(V.result_tables(spark, sf_dir)))


def _stats_page(parts):
    pairs = F.sort_array(F.collect_list(F.concat("attack_type_name", F.lit("="), F.col("count").cast("string"))))
    newest = F.sort_array(F.collect_list(F.struct("threat.created_at", "threat.id")), asc=False)
    ids = F.transform(newest, lambda r: r["id"].cast("string"))
    return parts["totals"].select(
        "total",
        "attacks",
        "attack_rate",
        parts["distribution"].agg(F.array_join(pairs, ";")).scalar().alias("distribution"),
        parts["recent"].agg(F.array_join(ids, ",")).scalar().alias("recent_ids"),
    )


_BATCHES = """SELECT batch_id, count(*) AS row_count, min(created_at) AS uploaded_at FROM traffic
    WHERE source = 'upload' AND batch_id IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1"""


@query(_BATCHES)
def upload_batch_list(spark, sf_dir):
    return D.merged_batches(V.dashboard_parts(spark, sf_dir)["cells"])


@query(_BATCHES)
def scanned_batch_list(spark, sf_dir):
    return A.list_batches(V.result_tables(spark, sf_dir)["traffic"])


_SUMMARY = """SELECT count(*) AS total, count(*) FILTER (is_attack OR attack_id IS NOT NULL) AS attacks,
    count(*) FILTER (NOT is_attack AND attack_id IS NULL) AS normal,
    count(*) FILTER (is_attack OR attack_id IS NOT NULL) * CAST(100 AS DOUBLE) / count(*) AS attack_rate
    FROM complete WHERE batch_id = 'batch-6'"""


@query(_SUMMARY)
def upload_summary(spark, sf_dir):
    return D.merged_summary(V.dashboard_parts(spark, sf_dir)["cells"], "batch-6")


@query(_SUMMARY)
def scanned_upload_summary(spark, sf_dir):
    return A.upload_summary(V.result_tables(spark, sf_dir), "batch-6")


@query(
    """SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks,
    count(*) - count(*) FILTER (is_attack) AS normal, round(avg(coalesce(prediction_score, 0)), 9) AS avg_threat_score
    FROM (SELECT * FROM live ORDER BY created_at DESC, id DESC LIMIT 100)"""
)
def rolling_stats(spark, sf_dir):
    rows = A.rolling_stats(live_messages(spark, sf_dir))
    return rows.withColumn("avg_threat_score", F.round("avg_threat_score", 9))


@query(
    """SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks,
    count(*) - count(*) FILTER (is_attack) AS normal, round(avg(coalesce(prediction_score, 0)), 9) AS avg_threat_score
    FROM (SELECT * FROM live ORDER BY created_at DESC, id DESC LIMIT 2500)"""
)
def rolling_stats_of_2500(spark, sf_dir):
    """A buffer of any size holds as many rows as it was asked for."""
    rows = A.rolling_stats(live_messages(spark, sf_dir), 2500)
    return rows.withColumn("avg_threat_score", F.round("avg_threat_score", 9))


_HEAT = """SELECT g.day, g.hour, coalesce(c.n, 0) AS "count" FROM
    (SELECT d.day, d.i, h.hour FROM (VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'),
    (6, 'Sun')) d(i, day), (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h) g
    LEFT JOIN (SELECT isodow(created_at) - 1 AS i, hour(created_at) AS hour, count(*) AS n FROM threat
    WHERE is_attack GROUP BY 1, 2) c ON c.i = g.i AND c.hour = g.hour"""


_HEATMAP = f"""SELECT day, hour, "count", CASE WHEN x = 0 THEN 0 WHEN x < CAST(0.2 AS DOUBLE) THEN 1
    WHEN x < CAST(0.4 AS DOUBLE) THEN 2 WHEN x < CAST(0.6 AS DOUBLE) THEN 3 WHEN x < CAST(0.8 AS DOUBLE) THEN 4
    ELSE 5 END AS level FROM (SELECT *, "count" / CAST(greatest(max("count") OVER (), 1) AS DOUBLE) AS x FROM ({_HEAT}))"""


@query(_HEATMAP)
def attack_heatmap(spark, sf_dir):
    return D.merged_heatmap(V.dashboard_parts(spark, sf_dir)["cells"])


@query(_HEATMAP)
def scanned_heatmap(spark, sf_dir):
    return A.attack_heatmap(V.result_tables(spark, sf_dir)["threat"])


@query(
    """WITH span AS (SELECT min(epoch_us(created_at)) AS lo, max(epoch_us(created_at)) AS hi FROM threat),
    sized AS (SELECT lo, CAST(ceil((hi - lo + 1) / CAST(12 AS DOUBLE)) AS BIGINT) AS width FROM span),
    counted AS (SELECT (epoch_us(created_at) - lo) // width AS bucket, count(*) AS total,
        count(*) FILTER (is_attack) AS attacks FROM threat, sized GROUP BY 1),
    series AS (SELECT CAST(range AS INTEGER) AS bucket, coalesce(total, 0) AS total, coalesce(attacks, 0) AS attacks,
        round(coalesce(attacks * CAST(100 AS DOUBLE) / nullif(total, 0), 0), 2) AS attack_rate
        FROM range(12) LEFT JOIN counted ON bucket = range)
    SELECT *, round((total - lag(total) OVER w) * CAST(100 AS DOUBLE) / nullif(lag(total) OVER w, 0), 2) AS total_trend,
    round((attacks - lag(attacks) OVER w) * CAST(100 AS DOUBLE) / nullif(lag(attacks) OVER w, 0), 2) AS attacks_trend,
    round((attack_rate - lag(attack_rate) OVER w) * CAST(100 AS DOUBLE) / nullif(lag(attack_rate) OVER w, 0), 2)
    AS attack_rate_trend FROM series WINDOW w AS (ORDER BY bucket)"""
)
def kpi_history(spark, sf_dir):
    return A.kpi_history(V.result_tables(spark, sf_dir)["threat"])


_PER_SECOND = """SELECT date_trunc('second', created_at) AS window_start, count(*) AS total,
    count(*) FILTER (is_attack) AS threats, count(*) - count(*) FILTER (is_attack) AS normal FROM live GROUP BY 1"""


@query(_PER_SECOND)
def throughput_per_second(spark, sf_dir):
    return A.throughput(live_messages(spark, sf_dir))


@query(f"SELECT * FROM ({_PER_SECOND}) ORDER BY window_start DESC LIMIT 30")
def last_throughput_points(spark, sf_dir):
    return R.last_n(A.throughput(live_messages(spark, sf_dir)), 30, "window_start")


# Model registry rows over `supplier`; a missing size counts as 0.
MODELS = """SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'threat_detector' ELSE 'attack_classifier' END
    AS model_type, concat('v', CAST(s_suppkey AS STRING)) AS version,
    CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(floor(s_acctbal * 1000) AS BIGINT) END AS file_size_bytes,
    s_nationkey IN (4, 7) AS is_active FROM supplier"""


def registry(spark, sf_dir):
    return spark.sql(MODELS.replace("FROM supplier", f"FROM parquet.`{sf_dir}/supplier.parquet`"))


@query(
    f"""SELECT t.model_type, count(m.id) AS "count", CAST(coalesce(sum(m.file_size_bytes), 0) AS BIGINT) AS size_bytes,
    count(*) FILTER (m.is_active) AS active_count, arg_min(m.version, m.id) FILTER (m.is_active) AS active_version,
    (SELECT count(*) FROM ({MODELS})) AS total_models,
    (SELECT CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) FROM ({MODELS})) AS total_bytes,
    (SELECT round(coalesce(sum(file_size_bytes), 0) / CAST(1048576 AS DOUBLE), 2) FROM ({MODELS})) AS total_mb
    FROM (VALUES ('threat_detector'), ('attack_classifier')) t(model_type)
    LEFT JOIN ({MODELS}) m ON m.model_type = t.model_type GROUP BY 1"""
)
def registry_storage(spark, sf_dir):
    return A.registry_stats(registry(spark, sf_dir))


@query('SELECT count(*) AS "all", count(*) FILTER (is_active) AS active FROM whitelist')
def whitelist_counts(spark, sf_dir):
    dim = V.whitelist(spark, sf_dir)
    both = A.whitelist_count(dim).withColumnRenamed("count", "all")
    return both.select("all", A.whitelist_count(dim, active_only=True).scalar().alias("active"))


@query('SELECT round(avg(value), 9) AS mean, round(quantile_cont(value, 0.95), 9) AS p95 FROM events')
def latency_percentile(spark, sf_dir):
    rows = A.latency_summary(V.read_table(spark, sf_dir, "events"), "value")
    return rows.select(F.round("mean", 9).alias("mean"), F.round("p95", 9).alias("p95"))
