"""Profiling, cleaning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.operators import evaluation as E
from flowward.operators import profiling as P
from flowward.operators.quantiles import exact_quantiles
from flowward.operators.recent import latest_per
from flowward.operators.scoring import rule_attack_class, rule_threat_score
from flowward.operators.sets import split
from flowward.plans.catalog.registry import query
from flowward.profiles import THREAT_LEGACY
from flowward.sources import flow_views as V

_COLS = THREAT_LEGACY.columns


@query('SELECT event_type AS value, count(*) AS "count" FROM events GROUP BY 1')
def event_type_counts(spark, sf_dir):
    return P.value_counts(V.read_table(spark, sf_dir, "events"), "event_type")


def _summary_sql(c: str) -> str:
    q = f'"{c}"'
    quartiles = ", ".join(f"round(quantile_cont({q}, {p}), 6) AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return (
        f"SELECT '{c}' AS \"column\", count({q}) AS \"count\", round(avg({q}), 6) AS mean, round(stddev_samp({q}), 6) AS std, "
        f"min({q}) AS min, {quartiles}, max({q}) AS max FROM flow10"
    )


@query(" UNION ALL ".join(_summary_sql(c) for c in _COLS))
def column_summary(spark, sf_dir):
    rows = P.column_summary(V.flow10(spark, sf_dir), _COLS)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    " UNION ALL ".join(
        f"""SELECT {i} AS place, '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null FROM messages"""
        for i, (c, t) in enumerate((("id", "bigint"), ("sender_ip", "string"), ("source", "string"), ("batch_id", "string")))
    )
)
def column_types(spark, sf_dir):
    return P.column_types(V.messages(spark, sf_dir).select("id", "sender_ip", "source", "batch_id"))


@query("SELECT count(*) AS rows, 4 AS columns FROM messages")
def table_shape(spark, sf_dir):
    return P.shape(V.messages(spark, sf_dir).select("id", "sender_ip", "source", "batch_id"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 5")
def first_rows(spark, sf_dir):
    return P.head(V.read_table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def _text_sql(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique",
        first(v ORDER BY n DESC, v) AS top, max(n) AS freq
        FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)"""


@query(" UNION ALL ".join(_text_sql(c, "events") for c in ("event_type", "props")))
def text_summary(spark, sf_dir):
    return P.text_summary(V.read_table(spark, sf_dir, "events"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM messages"
        for c in ("id", "sender_ip", "source", "batch_id")
    )
)
def null_counts(spark, sf_dir):
    return P.null_counts(V.messages(spark, sf_dir))


@query(
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates
    FROM lineitem"""
)
def duplicate_line_keys(spark, sf_dir):
    return P.duplicate_count(V.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_user_events(spark, sf_dir):
    return P.dedup(V.read_table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT DISTINCT attack_type_name AS value FROM attack")
def distinct_attack_types(spark, sf_dir):
    return P.distinct_values(V.result_tables(spark, sf_dir)["attack"], "attack_type_name")


_CORR_COLS = ["service", "flag", "src_bytes", "dst_bytes", "count", "same_srv_rate", "diff_srv_rate"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(\"{a}\", \"{b}\"), 6) AS correlation FROM flow10"
        for a in _CORR_COLS
        for b in _CORR_COLS
    )
)
def correlation_matrix(spark, sf_dir):
    rows = P.correlation_matrix(V.flow10(spark, sf_dir), _CORR_COLS)
    return rows.withColumn("correlation", F.round("correlation", 6))


# A prediction to judge: the rule decision as truth, many connections as guess, the rule score as score.
_JUDGED = """SELECT CAST(t.is_attack AS INTEGER) AS label, CAST(f."count" > 250 AS INTEGER) AS prediction,
    f.dst_host_srv_count / CAST(255 AS DOUBLE) AS score FROM threat t JOIN flow10 f ON f.id = t.id"""


def judged(spark, sf_dir):
    scored = rule_threat_score(V.flow10(spark, sf_dir))
    return scored.select(
        F.col("is_attack").cast("int").alias("label"),
        (F.col("count") > 250).cast("int").alias("prediction"),
        (F.col("dst_host_srv_count") / 255).alias("score"),
    )


@query(f'SELECT label, prediction, count(*) AS "count" FROM ({_JUDGED}) GROUP BY 1, 2')
def confusion_counts(spark, sf_dir):
    return E.confusion(judged(spark, sf_dir), "label", "prediction")


@query(
    f"""SELECT label, count(*) FILTER (prediction = 0) AS "0", count(*) FILTER (prediction = 2) AS "2",
    count(*) FILTER (prediction = 1) AS other FROM ({_JUDGED}) GROUP BY 1"""
)
def confusion_matrix_with_unlisted_class(spark, sf_dir):
    """Predictions of a class that the matrix was not asked for are counted, not lost."""
    return E.confusion_matrix(judged(spark, sf_dir), "label", "prediction", [0, 2])


@query(
    f"""SELECT label, count(*) FILTER (prediction = 0) AS "0", count(*) FILTER (prediction = 1) AS "1", 0 AS other
    FROM ({_JUDGED}) GROUP BY 1"""
)
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(judged(spark, sf_dir), "label", "prediction", [0, 1])


@query(f"SELECT avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM ({_JUDGED})")
def prediction_accuracy(spark, sf_dir):
    return E.accuracy(judged(spark, sf_dir), "label", "prediction")


def _report_sql(pairs: str) -> str:
    return f"""WITH pairs AS ({pairs}),
    classes AS (SELECT label AS c FROM pairs UNION SELECT prediction FROM pairs),
    counted AS (SELECT c, (SELECT count(*) FROM pairs WHERE label = c) AS support,
        (SELECT count(*) FROM pairs WHERE prediction = c) AS predicted,
        (SELECT count(*) FROM pairs WHERE prediction = c AND label = c) AS correct FROM classes),
    rated AS (SELECT *, coalesce(correct / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS p,
        coalesce(correct / CAST(nullif(support, 0) AS DOUBLE), 0) AS r FROM counted),
    scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rated)
    SELECT "class", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
    SELECT CAST(c AS VARCHAR) AS "class", p AS precision, r AS recall, f AS f1, support FROM scored
    UNION ALL SELECT 'accuracy', sum(correct) / sum(support), sum(correct) / sum(support), sum(correct) / sum(support),
        CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
        sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scored)"""


def _rounded(report):
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_report_sql(f"SELECT label, prediction FROM ({_JUDGED})"))
def threat_classification_report(spark, sf_dir):
    return _rounded(E.classification_report(judged(spark, sf_dir), "label", "prediction"))


@query(_report_sql("SELECT code AS label, CASE WHEN ack_flag_count > 25 THEN code ELSE id % 14 END AS prediction FROM class42"))
def attack_classification_report(spark, sf_dir):
    scored = rule_attack_class(V.flow42(spark, sf_dir))
    guess = F.when(F.col("ack_flag_count") > 25, F.col("attack_type_encoded")).otherwise(F.col("id") % 14)
    rows = scored.select(F.col("attack_type_encoded").alias("label"), guess.cast("int").alias("prediction"))
    return _rounded(E.classification_report(rows, "label", "prediction"))


_POINTS = f"""SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    pos, neg FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM ({_JUDGED}) GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""


@query(
    f"""SELECT score AS threshold, CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(p AS DOUBLE)
    AS tpr FROM ({_POINTS}) UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0"""
)
def roc_points(spark, sf_dir):
    return E.roc_curve(judged(spark, sf_dir), "label", "score")


@query(
    f"""SELECT round(sum(CAST(neg AS DOUBLE) * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2))
    / (CAST(max(p) AS DOUBLE) * CAST(max(n) AS DOUBLE)), 9) AS auc FROM ({_POINTS})"""
)
def area_under_roc(spark, sf_dir):
    return E.auc(judged(spark, sf_dir), "label", "score").select(F.round("auc", 9).alias("auc"))


_POINT = "CAST('0x' || substr(md5(concat(CAST(event_id AS VARCHAR), '/42')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


@query(
    f"""SELECT event_id AS id, CASE WHEN u < CAST(0.6 AS DOUBLE) THEN 'train' WHEN u < CAST(0.8 AS DOUBLE)
    THEN 'validation' ELSE 'test' END AS part FROM (SELECT event_id, {_POINT} AS u FROM events)"""
)
def train_validation_test_split(spark, sf_dir):
    flows = V.flow10(spark, sf_dir).select("id")
    parts = split(flows, [0.6, 0.2, 0.2], 42)
    tagged = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "validation", "test"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    """SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1"""
)
def last_event_per_type(spark, sf_dir):
    """Few keys, many rows each: every task reduces a key before the shuffle."""
    events = V.read_table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return latest_per(events, "event_type", ["event_id"])


_NARROWED = ("src_bytes", "count", "diff_srv_rate")
_PROBS = (0.25, 0.5, 0.95)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, round(quantile_cont("{c}", {p}), 6) AS value FROM flow10"""
        for c in _NARROWED
        for p in _PROBS
    )
)
def narrowed_quantiles(spark, sf_dir):
    """Exact quantiles by counted passes over the data, as for columns too long to sort in one task."""
    found = exact_quantiles(V.flow10(spark, sf_dir), _NARROWED, _PROBS, sort_limit=20)
    return found.withColumn("value", F.round("value", 6))
