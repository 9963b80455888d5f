"""Whole-table operators against plain computations on small frames."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowward.operators import aggregates as A
from flowward.operators import dimensions as D
from flowward.operators import evaluation as E
from flowward.operators import joins as J
from flowward.operators import membership as M
from flowward.operators import recent as R
from flowward.operators.profiling import column_summary, correlation_matrix, text_summary
from flowward.operators import quantiles as Q
from flowward.operators.quantiles import exact_quantiles
from flowward.operators.sets import split, union_all
from flowward.profiles import default_sources
from flowward.sources.bucketed import bucketed_complete, write_bucketed

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [1_000_000, 50, 1])
def test_quantiles_are_exact_however_far_they_narrow(spark, limit):
    rng = random.Random(3)
    columns = {
        "even": [float(i) for i in range(1000)],
        "tied": [5.0] * 400 + [rng.random() * 10 for _ in range(600)],
        "edges": [-1e300, 1e300] + [rng.gauss(0, 1) for _ in range(998)],
        "same": [2.5] * 1000,
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, list(columns), probs, limit).collect()}
    for c, values in columns.items():
        for p in probs:
            assert got[(c, p)] == pytest.approx(np.quantile(values, p), rel=1e-12), (c, p)


def test_quantile_passes_do_not_grow_with_columns_and_ranks(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id AS a", "id * 7 % 5000 AS b", "id % 3 AS c", "cast(null AS double) AS d")
    passes = []
    narrow = Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *args: passes.append(1) or narrow(*args))
    counts = []
    for cols, probs in ((["a"], [0.5]), (["a", "b", "c", "d"], [0.01 * k for k in range(1, 100)])):
        passes.clear()
        rows = exact_quantiles(df, cols, probs, 100).collect()
        counts.append(len(passes))
        assert len(rows) == len(probs) * min(len(cols), 3)
        for r in rows:
            values = {"a": range(5000), "b": range(5000), "c": [k % 3 for k in range(5000)]}[r["column"]]
            assert r["value"] == pytest.approx(np.quantile(list(values), r["prob"]), rel=1e-12)
    assert counts == [1, 1]


def test_quantiles_leave_missing_values_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (float("inf"),)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]).first()["value"] == 3.0


@pytest.fixture
def many_partitions(spark):
    """Spark would put tables as small as these into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals_over_many_partitions(spark, many_partitions):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i, rng.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, id int, n bigint").repartition(7)
    got = {r["id"]: r["cum_n"] for r in R.cumulative(df, ["k", "id"], ["n"]).collect()}
    total, want = 0, {}
    for _, i, n in sorted(rows):
        total += n
        want[i] = total
    assert got == want
    numbered = R.with_sequence(df, [F.col("k").desc(), "id"]).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert {r["id"]: r["index"] for r in numbered} == {r[1]: i + 1 for i, r in enumerate(order)}


def _tasks(df):
    """Rows by ``_part``."""
    return {r["_part"]: r["count"] for r in df.groupBy("_part").count().collect()}


def test_ties_of_the_order_key_are_split(spark, many_partitions):
    rows = [(1 if i % 2 else i, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, n bigint").repartition(7)
    assert max(_tasks(R._ranged(df, ["k"])).values()) < 1500
    got = sorted((r["cum_n"], r["k"]) for r in R.cumulative(df, ["k"], ["n"]).collect())
    assert [c for c, _ in got] == list(range(1, 4001))
    assert [k for _, k in got] == sorted(k for k, _ in rows)


def test_changes_go_on_over_partitions(spark, many_partitions):
    rng = random.Random(8)
    values = [rng.choice([None, 0.0, 1.0, 2.5, 7.0]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(5)
    want = {0: None}
    for k in range(1, 1500):
        a, b = values[k - 1], values[k]
        want[k] = None if not a or b is None else (b - a) * 100.0 / a
    got = R.pct_change(df, "k", "v")
    assert got.columns == ["k", "v", "trend"]
    assert {r["k"]: r["trend"] for r in got.collect()} == want
    assert R.pct_change(df.where("k < 0"), "k", "v").count() == 0


@pytest.mark.parametrize("bits", [None, 1 << 15])
def test_a_filter_loses_no_match(spark, monkeypatch, bits):
    if bits:  # far too small a filter
        monkeypatch.setattr(M, "MOST_BITS", bits)
    keys = spark.range(6000).select(F.concat(F.lit("10.0."), F.col("id") * 3).alias("sender_ip"), (F.col("id") % 5 > 0).alias("is_active"))
    facts = spark.range(40_000).select("id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("10.0."), F.col("id"))).alias("sender_ip"))
    facts = facts.withColumn("_slot", F.lit("mine"))
    allowed = keys.where("is_active").select("sender_ip")
    maybe, absent = M.by_filter(facts, allowed, "sender_ip")
    assert maybe.columns == absent.columns == facts.columns
    assert maybe.count() + absent.count() == 40_000
    assert absent.join(allowed, "sender_ip", "left_semi").count() == 0
    matches = facts.join(allowed, "sender_ip", "left_semi").count()
    if not bits:
        assert maybe.count() - matches < 40_000 / 16
    whitelist = keys.withColumnRenamed("sender_ip", "ip_address")
    flags = [J.admitted_flag(facts, whitelist, prefilter=p).where("admitted").select("id").collect() for p in (True, False)]
    assert sorted(flags[0]) == sorted(flags[1]) and len(flags[0]) == matches
    none = J.admitted_flag(facts, whitelist.where("false"), prefilter=True)
    assert none.count() == 40_000 and none.where("admitted").count() == 0


def test_bucketed_tables_are_joined_where_they_lie(spark, tmp_path):
    traffic = spark.range(500).selectExpr("id", "id % 7 AS n", "map('a', id * 1D) AS features")
    threat = spark.range(0, 500, 2).selectExpr("id + 1000 AS id", "CASE WHEN id > 10 THEN id END AS traffic_data_id")
    attack = spark.range(0, 500, 3).selectExpr("id + 2000 AS id", "id AS traffic_data_id")
    action = spark.range(0, 500, 6).selectExpr("id + 3000 AS id", "id + 2000 AS attack_prediction_id")
    tables = {"traffic": traffic, "threat": threat, "attack": attack, "action": action}
    path = str(tmp_path)
    write_bucketed(tables, path, 8)
    found = bucketed_complete(spark, path, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = sorted(map(repr, J.complete_predictions(**tables).collect()))
    assert sorted(map(repr, found.collect())) == want
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]:
        spark.sql(f"DROP TABLE {name}")  # as in a session that did not write them
    again = bucketed_complete(spark, path, 8)
    assert sorted(map(repr, again.collect())) == want
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


def test_latest_per_takes_the_whole_row(spark):
    rows = [("a", 1, "x"), ("a", 3, None), ("b", 2, "z"), ("a", 2, "y")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    assert sorted(map(tuple, R.latest_per(df, "k", ["at"]).collect())) == [("a", 3, None), ("b", 2, "z")]


def test_limit_before_and_after_the_filter(spark):
    rows = [(i, T0, i < 5) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp, is_attack boolean")
    assert R.recent_threats(df, 5, attacks_only=True).count() == 0
    assert R.recent_threats(df, 3, attacks_only=True, filter_first=True).count() == 3
    assert [r["id"] for r in R.recent_threats(df, 2).collect()] == [9, 8]
    assert R.recent_threats(df, 5000).count() == 10
    with pytest.raises(ValueError):
        R.recent_threats(df, -1)


def test_no_listing_is_shorter_than_asked_for(spark):
    df = spark.range(3000).select("id", F.timestamp_seconds("id").alias("created_at"), (F.col("id") % 2 == 0).alias("is_attack"))
    scored = df.withColumn("prediction_score", F.lit(0.5))
    assert R.recent_threats(scored, 2500).count() == 2500
    assert A.rolling_stats(scored, 2500).first()["total"] == 2500


def test_predictions_of_unlisted_classes_are_counted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, None)], "label int, prediction int")
    rows = {r["label"]: (r["0"], r["1"], r["other"]) for r in E.confusion_matrix(df, "label", "prediction", [0, 1]).collect()}
    assert rows == {0: (1, 0, 1), 1: (0, 1, 1)}


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_lookup_in_a_large_dimension_is_salted(spark, how):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id int, key string")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2)], "key string, v int")
    small = sorted(map(str, J.dim_lookup(facts, dim, "key", how).collect()))
    large = J.dim_lookup(facts, dim, "key", how, salts=16)
    assert sorted(map(str, large.collect())) == small
    assert "_salt" in large._jdf.queryExecution().toString()


def test_empty_tables_give_zero_rates(spark):
    empty = spark.createDataFrame([], "id bigint, created_at timestamp, prediction_score double, is_attack boolean")
    assert tuple(A.threat_stats(empty).first()) == (0, 0, 0, 0.0)
    assert tuple(A.rolling_stats(empty).first()) == (0, 0, 0, 0.0)
    assert A.attack_heatmap(empty).where("count = 0 and level = 0").count() == 168


def test_heatmap_cells(spark):
    rows = [(T0 + timedelta(hours=h), True) for h in (0, 0, 25)] + [(T0, False)]
    cells = A.attack_heatmap(spark.createDataFrame(rows, "created_at timestamp, is_attack boolean"))
    got = {(r["day"], r["hour"]): (r["count"], r["level"]) for r in cells.where("count > 0").collect()}
    assert got == {("Mon", 0): (2, 5), ("Tue", 1): (1, 3)}


def test_registry_lists_both_types(spark):
    schema = "id int, model_type string, version string, is_active boolean, file_size_bytes bigint"
    rows = [(1, "threat_detector", "a", False, None), (2, "threat_detector", "b", True, 3 * 1024 * 1024)]
    got = {r["model_type"]: r for r in A.registry_stats(spark.createDataFrame(rows, schema)).collect()}
    assert got["threat_detector"]["active_version"] == "b" and got["threat_detector"]["size_bytes"] == 3145728
    assert got["attack_classifier"]["count"] == 0 and got["attack_classifier"]["total_mb"] == 3.0


def test_complete_predictions_keep_rows_without_predictions(spark):
    tables = {
        "traffic": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "threat": spark.createDataFrame([(10, 1, True)], "id bigint, traffic_data_id bigint, is_attack boolean"),
        "attack": spark.createDataFrame([(20, 2, "Bot")], "id bigint, traffic_data_id bigint, attack_type_name string"),
        "action": spark.createDataFrame([(30, 20, "alert_admin")], "id bigint, attack_prediction_id bigint, action_type string"),
    }
    got = {r["traffic"]["id"]: r for r in J.complete_predictions(**tables).collect()}
    assert got[1]["threat"]["is_attack"] and got[1]["attack"] is None and got[1]["action"] is None
    assert got[2]["threat"] is None and got[2]["action"]["action_type"] == "alert_admin"


def test_evaluation_of_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    points = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in E.roc_curve(df, "label", "score").collect())
    third = pytest.approx(1 / 3)
    assert points == [(0.1, 1.0, 1.0), (0.5, third, 1.0), (0.9, third, 0.5), (float("inf"), 0.0, 0.0)]
    assert E.auc(df, "label", "score").first()[0] == pytest.approx((2 + 0.5 + 2) / 6)


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    got = {r["class"]: r for r in E.classification_report(df, "label", "pred").collect()}
    assert got["1"]["precision"] == got["1"]["f1"] == 0.0 and got["1"]["support"] == 1
    assert got["accuracy"]["f1"] == pytest.approx(2 / 3) and got["macro avg"]["recall"] == 0.5


def test_summaries(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "a"), (None, "b")], "x double, t string")
    row = column_summary(df).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (3, 1.0, 2.0, 4.0)
    assert tuple(text_summary(df).first())[1:] == (4, 2, "a", 2)
    constant = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, v double")
    cells = {(r["column_a"], r["column_b"]): r["correlation"] for r in correlation_matrix(constant).collect()}
    assert cells[("c", "v")] is None and cells[("v", "v")] == pytest.approx(1.0)


def test_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(5000).repartition(5)
    parts = [{r["id"] for r in p.collect()} for p in split(df, [0.8, 0.2], 42)]
    assert parts[0].isdisjoint(parts[1]) and len(parts[0] | parts[1]) == 5000
    assert abs(len(parts[0]) - 4000) < 150
    assert {r["id"] for r in split(df.repartition(3), [0.8, 0.2], 42)[0].collect()} == parts[0]


def test_shuffle_and_union(spark):
    df = spark.range(100)
    first = [r["id"] for r in R.shuffle_rows(df, 1).collect()]
    assert first == [r["id"] for r in R.shuffle_rows(df.repartition(9), 1).collect()]
    assert first != sorted(first) and first != [r["id"] for r in R.shuffle_rows(df, 2).collect()]
    assert union_all(df, df.withColumn("x", F.lit(1))).where("x is null").count() == 100


def models(spark):
    rows = [(1, "threat_detector", "a", True), (2, "threat_detector", "b", False), (3, "attack_classifier", "c", True)]
    return spark.createDataFrame(rows, "id int, model_type string, version string, is_active boolean")


def test_activation_is_exclusive_per_type(spark):
    got = {r["id"]: r["is_active"] for r in D.activate(models(spark), 2).collect()}
    assert got == {1: False, 2: True, 3: True}
    with pytest.raises(D.DimensionError):
        D.activate(models(spark), 99)
    assert not D.deactivate(models(spark), 3).where("is_active and id = 3").count()


def test_active_rows_cannot_be_deleted(spark):
    keys = spark.createDataFrame([(1,), (7,)], "id int")
    with pytest.raises(D.DimensionError):
        D.delete_keys(models(spark), keys, guard=F.col("is_active"))
    left, unknown = D.delete_keys(models(spark), spark.createDataFrame([(2,), (7,)], "id int"), guard=F.col("is_active"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3] and [r["id"] for r in unknown.collect()] == [7]


def test_sources(spark):
    config = default_sources(spark)
    assert {r["source_name"]: r["is_enabled"] for r in config.collect()} == {
        "packet_capture": False,
        "external_kafka": False,
        "internal_kafka": True,
    }
    messages = spark.createDataFrame([(1, "internal_kafka"), (2, "external_kafka"), (3, "other")], "id int, source string")
    assert [r["id"] for r in J.gate_sources(messages, config).collect()] == [1]
    assert D.ensure_defaults(config.where("is_enabled")).count() == 3
    changed = D.set_param(config, "packet_capture", "interface", "eth0")
    assert D.get_param(changed, "packet_capture", "interface").first()["value"] == "eth0"
    assert D.get_param(changed, "packet_capture", "buffer_size").first()["value"] == "1000"


def test_whitelist_is_exact_and_active_only(spark):
    dim = spark.createDataFrame([("10.0.0.1", True), ("10.0.0.2", False)], "ip_address string, is_active boolean")
    rows = [(1, "10.0.0.1"), (2, "10.0.0.2"), (3, "10.0.0.10"), (4, None)]
    ok, rejected = J.admit(spark.createDataFrame(rows, "id int, sender_ip string"), dim)
    assert [r["id"] for r in ok.collect()] == [1] and sorted(r["id"] for r in rejected.collect()) == [2, 3, 4]
