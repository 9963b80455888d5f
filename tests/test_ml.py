"""Training, scaling, encoding and bundles on generated flows."""

import numpy as np
import pytest
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.sql import functions as F

from flowward.ml import forest as forests
from flowward.ml.bundle import load_bundle, save_bundle
from flowward.ml.encoding import encode, encode_target, fit_encoder
from flowward.ml.pipelines import train_attack_classifier, train_threat_detector
from flowward.ml.scaling import fit_robust, fit_standard, scale
from flowward.ml.scorers import ProfileScorer, score_attack, score_threat, soft_vote
from flowward.ml.network import add_gradient, unrolled
from flowward.ml.selection import drop_correlated
from flowward.ml.training import train_forest, train_mlp
from flowward.profiles import ATTACK_FEATURES, THREAT_LEGACY, FeatureProfile
from flowward.sources.generators import gen_attack, gen_threat


def test_generated_flows(spark):
    df = gen_threat(spark, 800, 200)
    counts = {r["class"]: r for r in df.groupBy("class").agg(F.count("*").alias("n"), F.avg("count").alias("c")).collect()}
    assert counts["normal"]["n"] == 800 and counts["anomaly"]["n"] == 200
    assert abs(counts["normal"]["c"] - 10) < 1 and abs(counts["anomaly"]["c"] - 100) < 4
    assert df.collect() == gen_threat(spark, 800, 200).collect()
    attacks = gen_attack(spark, 500)
    assert attacks.columns == [*ATTACK_FEATURES, " Label"]
    spread = attacks.agg(F.stddev("` Flow Duration`"), F.count_distinct("` Label`")).first()
    assert abs(spread[0] - 1000) < 150 and spread[1] == 14


def test_codes_are_alphabetical_per_column(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), ("a", "y")], "s string, t string")
    encoder = fit_encoder(df, ["s", "t"])
    codes = {(r["column"], r["value"]): r["code"] for r in encoder.collect()}
    assert codes == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 2, ("t", "nan"): 0, ("t", "x"): 1, ("t", "y"): 2}
    new = spark.createDataFrame([("c", None), ("z", "x")], "s string, t string")
    assert sorted(map(tuple, encode(new, encoder, ["s", "t"]).collect()), key=str) == [(2.0, 0.0), (None, 1.0)]
    target = df.select(encode_target(F.col("s"), "a").alias("y")).collect()
    assert [r["y"] for r in target] == [1.0, 0.0, 1.0, 0.0]


def test_scaling_uses_population_and_exact_statistics(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(100)], "x double, c double")
    standard, robust = fit_standard(df, ["x", "c"]), fit_robust(df, ["x", "c"])
    assert standard.width[0] == pytest.approx(28.86607, abs=1e-5) and robust.center[0] == 49.5
    assert robust.width == (49.5, 1.0)
    assert {r["c"] for r in scale(df, standard).collect()} == {0.0}


def test_scaling_leaves_empty_columns_alone(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(10)], "x double, empty double")
    for fit in (fit_standard, fit_robust):
        scaling = fit(df, ["x", "empty"])
        assert scaling.width[1] == 1.0 and scale(df, scaling).where("empty is not null").count() == 0


def test_generators_do_not_depend_on_partitions(spark):
    few = sorted(map(str, gen_attack(spark, 50).collect()))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert sorted(map(str, gen_attack(spark, 50).collect())) == few
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)


def test_correlation_filter_counts_dropped_columns_too(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"),
        (F.col("id") * 2.0).alias("b"),
        (F.col("id") * -3.0 + 1).alias("c"),
        F.rand(1).alias("d"),
        F.lit(1.0).alias("k"),
    )
    assert drop_correlated(df, ["a", "b", "c", "d", "k"]) == (["a", "d", "k"], ["b", "c"])


def test_threat_recipe_and_bundle(spark, tmp_path):
    df = gen_threat(spark, 400, 100).withColumn("num_outbound_cmds", F.lit(0))
    bundle, results = train_threat_detector(df, k=5, trees=10, depth=5, rfe_trees=5)
    assert len(bundle.features) == 5 and "num_outbound_cmds" not in bundle.features
    assert bundle.metadata["accuracy"] > 0.95
    assert results["auc"].first()[0] > 0.95
    save_bundle(bundle, str(tmp_path / "b"), spark)
    loaded = load_bundle(spark, str(tmp_path / "b"))
    rows = df.withColumn("id", F.monotonically_increasing_id())
    first = score_threat(rows, bundle).select("id", "prediction_score", "service").collect()
    again = score_threat(rows, loaded).select("id", "prediction_score", "service").collect()
    assert sorted(first) == sorted(again)
    with pytest.raises(ValueError, match="Missing required features"):
        score_threat(rows.drop(*bundle.features), loaded)


def test_attack_recipe_keeps_its_own_labels(spark):
    df = gen_attack(spark, 300).withColumn("` Label`".strip("`"), F.when(F.col("` Flow Duration`") > 0, "Up").otherwise("Down"))
    bundle, results = train_attack_classifier(df, depth=3)
    assert bundle.labels == ("Down", "Up") and bundle.metadata["accuracy"] > 0.95
    scored = score_attack(df, bundle).first()
    assert scored["attack_type_name"] in bundle.labels and 0 <= scored["confidence"] <= 1
    assert {r["class"] for r in results["report"].collect()} >= {"0.0", "1.0", "accuracy"}


def test_python_models_and_votes(spark):
    profile = FeatureProfile("two", "attack_classification", ("p", "q"), ("low", "high"))
    df = spark.createDataFrame([(1, 0.2, 0.4), (2, 0.9, 0.8)], "id int, p double, q double")
    rows = ProfileScorer(profile, lambda f: (f["p"] > 0.5).astype(int)).transform(df).orderBy("id").collect()
    assert [r["attack_type_name"] for r in rows] == ["low", "high"] and rows[0]["confidence"] == 0.85
    voted = soft_vote(df, ["p", "q"]).orderBy("id").collect()
    assert [r["is_attack"] for r in voted] == [False, True]
    with pytest.raises(ValueError, match="Missing required features"):
        ProfileScorer(THREAT_LEGACY, lambda f: f["count"]).transform(df)


def test_network_is_fitted_without_mllibs_passes(spark, tmp_path, monkeypatch):
    df = spark.range(800).select(
        (F.col("id") % 40 / 20 - 1).alias("x"), (F.floor(F.col("id") / 40) / 10 - 1).alias("y")
    ).withColumn("label", (F.col("x") * F.col("y") > 0).cast("double"))
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model = train_mlp(df.union(df.limit(1).withColumn("x", F.lit(None))), ["x", "y"], hidden=(12, 6), epochs=100)
    assert max(seen) == 1
    assert model.transform(df).where("prediction <> label").count() < 40
    network = model.stages[-1]
    network.save(str(tmp_path / "n"))
    loaded = MultilayerPerceptronClassificationModel.load(str(tmp_path / "n"))
    assert loaded.weights == network.weights and loaded.getMaxIter() == 100
    with pytest.raises(Exception, match="Labels must be whole numbers from 0 to 1"):
        train_mlp(df.withColumn("label", F.lit(2.0)), ["x", "y"], hidden=(2,), epochs=1)


def test_network_gradient_is_that_of_its_loss():
    layers, draws = (3, 5, 4, 2), np.random.default_rng(1)
    weights, x, y = draws.normal(size=54), draws.normal(size=(20, 3)), draws.integers(0, 2, 20)
    loss = lambda w: add_gradient(unrolled(w, layers), x, y, unrolled(np.zeros(54), layers))
    gradient = np.zeros(54)
    add_gradient(unrolled(weights, layers), x, y, unrolled(gradient, layers))
    apart = [(loss(weights + e) - loss(weights - e)) / 2e-6 for e in np.eye(54) * 1e-6]
    assert np.allclose(gradient, apart, atol=1e-6)


def _ported(spark, n=3000):
    """Rows of three classes: a word-like column of few values, a wide one, one that says nothing."""
    rows = spark.range(n).select(
        (F.col("id") % 5).cast("double").alias("few"), (F.col("id") * 7919 % 3001).cast("double").alias("wide"), (F.col("id") % 11).alias("none")
    )
    return rows.withColumn("label", F.when(F.col("few") == 3, 2).when(F.col("wide") > 1500, 1).otherwise(0).cast("double"))


def test_forest_is_fitted_without_mllibs_passes(spark, monkeypatch):
    df, names = _ported(spark), ["few", "wide", "none"]
    seen, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model = train_forest(df.union(df.limit(1).withColumn("wide", F.lit(float("nan")))), names, trees=20, depth=6)
    assert max(seen) == 3  # one row a class, for the model's form
    forest = model.stages[-1]
    assert forest.getNumTrees == 20 and forest.numClasses == 3 and forest.featureImportances[2] < 0.1
    assert model.transform(df).where("prediction <> label").count() < 60
    assert train_forest(df, names, trees=20, depth=6).stages[-1].toDebugString.split("\n")[1:] == forest.toDebugString.split("\n")[1:]
    with pytest.raises(Exception, match="labels must be whole numbers"):
        train_forest(df.withColumn("label", F.lit(0.5)), names, trees=2, depth=2)


def test_forest_in_parts_is_the_same_forest(spark, monkeypatch):
    df, names = _ported(spark, 500), ["few", "wide", "none"]
    told = lambda: train_forest(df, names, trees=3, depth=7).stages[-1].toDebugString.split("\n")[1:]
    whole = told()
    monkeypatch.setattr(forests, "NODES", 1)
    monkeypatch.setattr(forests, "CELLS", 4 * 2 * 32 * 3)
    assert told() == whole


def test_best_split_of_a_node():
    counts = np.zeros((2, 2, 4, 2), int)
    counts[0, 0] = [[3, 1], [2, 2], [1, 3], [0, 0]]
    counts[0, 1] = [[6, 0], [0, 6], [0, 0], [0, 0]]
    counts[1] = [[0, 0], [4, 4], [0, 0], [0, 0]]
    first, second = forests.best_splits(counts, np.array([[5, 9], [5, 9]])).tolist()
    assert first == [0.5, 9, 0, 6, 0, 0, 6] and second[1:3] == [-1, -1]


def test_threat_recipe_scores_its_test_rows_once(spark):
    _, results = train_threat_detector(gen_threat(spark, 200, 50), k=9, trees=2, depth=3, rfe_trees=2)
    for name in ("accuracy", "report", "confusion", "roc", "auc"):
        assert "UDF" not in results[name]._jdf.queryExecution().analyzed().toString()
