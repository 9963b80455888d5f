"""Encoding, scaling, feature selection, training and model-backed scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowward.ml.bundle import ModelBundle, load_bundle, save_bundle
from flowward.ml.encoding import decode_labels, encode, encode_target, fit_encoder
from flowward.ml.pipelines import train_attack_classifier, train_threat_detector
from flowward.ml.scaling import fit_robust, fit_standard, scale
from flowward.ml.scorers import ProfileScorer, score_attack, score_threat, soft_vote, unscored
from flowward.ml.selection import drop_correlated, rfe
from flowward.ml.training import train_forest, train_mlp, train_tree
from flowward.operators.scoring import rule_attack_class, rule_threat_score
from flowward.operators.sets import split
from flowward.operators.validation import DROP, validate
from flowward.plans.catalog.registry import query
from flowward.plans.pipeline import score_frame, with_number_errors
from flowward.profiles import ATTACK_LABELS, ATTACK_PROFILE, THREAT_CURRENT, THREAT_LEGACY
from flowward.session import scratch_path
from flowward.sources import flow_views as V
from flowward.sources.generators import gen_attack, gen_threat

_COLS = THREAT_LEGACY.columns


def labelled_threats(spark, sf_dir):
    """Threat flows with the rule decision as label."""
    scored = rule_threat_score(V.flow10(spark, sf_dir))
    return scored.select("id", *_COLS, F.col("is_attack").cast("double").alias("label"))


def labelled_attacks(spark, sf_dir):
    """Attack flows with the rule class as label."""
    scored = rule_attack_class(V.flow42(spark, sf_dir))
    return scored.select("id", *ATTACK_PROFILE.columns, F.col("attack_type_encoded").cast("double").alias("label"))


@query(
    """SELECT id, prediction_score, prediction_score > CAST(0.5 AS DOUBLE) AS is_attack FROM (SELECT t.id,
    (t.prediction_score + f.dst_host_same_srv_rate) / 2 AS prediction_score FROM threat t JOIN flow10 f ON f.id = t.id)"""
)
def soft_vote_scores(spark, sf_dir):
    scored = rule_threat_score(V.flow10(spark, sf_dir)).withColumnRenamed("prediction_score", "first")
    voted = soft_vote(scored.drop("is_attack"), ["first", "dst_host_same_srv_rate"])
    return voted.select("id", "prediction_score", "is_attack")


_TEXTS = ("event_type", "props")


def _codes_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM (SELECT event_type,
        CASE WHEN user_id % 50 = 7 THEN NULL ELSE props END AS props FROM events))"""


def _texts(spark, sf_dir):
    events = V.read_table(spark, sf_dir, "events")
    props = F.when(F.col("user_id") % 50 != 7, F.col("props"))
    return events.select(F.col("event_id").alias("id"), "event_type", props.alias("props"))


@query(" UNION ALL ".join(_codes_sql(c) for c in _TEXTS))
def category_codes(spark, sf_dir):
    return fit_encoder(_texts(spark, sf_dir), _TEXTS)


@query(
    """SELECT event_id AS id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type,
    CAST(dense_rank() OVER (ORDER BY CASE WHEN user_id % 50 = 7 THEN 'nan' ELSE props END) - 1 AS DOUBLE) AS props
    FROM events"""
)
def encoded_rows(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return encode(texts, fit_encoder(texts, _TEXTS), _TEXTS)


@query("SELECT event_id AS id, CAST(event_type <> 'view' AS INTEGER) AS target FROM events")
def encoded_target(spark, sf_dir):
    events = V.read_table(spark, sf_dir, "events")
    target = encode_target(F.col("event_type"), "view").cast("int")
    return events.select(F.col("event_id").alias("id"), target.alias("target"))


@query("SELECT c.id, c.code, l.label AS label_name FROM class42 c JOIN labels14 l ON l.code = c.code")
def decoded_labels(spark, sf_dir):
    codes = rule_attack_class(V.flow42(spark, sf_dir)).select("id", F.col("attack_type_encoded").alias("code"))
    return decode_labels(codes, "code", ATTACK_LABELS)


def _scaled_sql(center: str, width: str) -> str:
    cols = ", ".join(f'round(("{c}" - {center.format(c=c)}) / {width.format(c=c)}, 6) AS "{c}"' for c in _COLS)
    return f"SELECT id, {cols} FROM flow10"


@query(_scaled_sql('(SELECT avg("{c}") FROM flow10)', '(SELECT stddev_pop("{c}") FROM flow10)'))
def standard_scaled(spark, sf_dir):
    flows = V.flow10(spark, sf_dir).select("id", *_COLS)
    return scale(flows, fit_standard(flows, _COLS)).withColumns({c: F.round(c, 6) for c in _COLS})


@query(
    _scaled_sql(
        '(SELECT quantile_cont("{c}", 0.5) FROM flow10)',
        '(SELECT quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) FROM flow10)',
    )
)
def robust_scaled(spark, sf_dir):
    flows = V.flow10(spark, sf_dir).select("id", *_COLS)
    return scale(flows, fit_robust(flows, _COLS)).withColumns({c: F.round(c, 6) for c in _COLS})


_MIXED = [*_COLS, "src_kb", "rate_sum"]
_MIXED_SQL = 'SELECT *, src_bytes / 1024 AS src_kb, same_srv_rate + diff_srv_rate / 10 AS rate_sum FROM flow10'


def _dropped_sql() -> str:
    parts = []
    for j, c in enumerate(_MIXED):
        strong = " OR ".join(f'abs(corr("{e}", "{c}")) > 0.85' for e in _MIXED[:j]) or "FALSE"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) > 0 AND ({strong}) AS dropped FROM ({_MIXED_SQL})")
    return " UNION ALL ".join(parts)


@query(_dropped_sql())
def correlated_columns(spark, sf_dir):
    """Which columns the correlation filter drops."""
    flows = V.flow10(spark, sf_dir).withColumns(
        {"src_kb": F.col("src_bytes") / 1024, "rate_sum": F.col("same_srv_rate") + F.col("diff_srv_rate") / 10}
    )
    kept, dropped = drop_correlated(flows, _MIXED)
    return spark.createDataFrame([(c, c in dropped) for c in kept + dropped], "column string, dropped boolean")


@query(
    """SELECT id, score AS prediction_score, score > CAST(0.5 AS DOUBLE) AS is_attack, 'mean_rate' AS model_version FROM
    (SELECT id, (same_srv_rate + diff_srv_rate) / 2 AS score FROM flow10)"""
)
def python_model_scores(spark, sf_dir):
    """A Python model over Arrow batches of the profile's columns."""
    scorer = ProfileScorer(
        THREAT_LEGACY, lambda f: (f["same_srv_rate"] + f["diff_srv_rate"]) / 2, version="mean_rate"
    )
    scored = scorer.transform(V.flow10(spark, sf_dir))
    return scored.select("id", "prediction_score", "is_attack", "model_version")


# -- trained models: their scores depend on MLlib's draws, so what is compared are facts about them ------

# The key's place in [0, 1) by which rows are split, and the part that models are tested on.
_POINT = "CAST(CAST('0x' || substr(md5(concat(CAST({id} AS VARCHAR), '/42')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296"
_TESTED = _POINT.format(id="id") + " >= CAST(0.8 AS DOUBLE)"


def _between(c: str):
    return F.coalesce(F.col(c).between(0, 1), F.lit(False))


@query(
    f"""SELECT id, CAST(is_attack AS DOUBLE) AS label, TRUE AS in_range, TRUE AS consistent, 'forest' AS model_version
    FROM threat WHERE {_TESTED}"""
)
def forest_scores(spark, sf_dir):
    """A random forest trained on most flows scores the rest."""
    train, test = split(labelled_threats(spark, sf_dir), [0.8, 0.2])
    scaling = fit_standard(train, _COLS)
    model = train_forest(scale(train, scaling), _COLS)
    bundle = ModelBundle(model, tuple(_COLS), ("Normal", "Attack"), scaling, metadata={"version": "forest"})
    scored = score_threat(test, bundle)
    consistent = F.col("is_attack") == (F.col("prediction_score") > 0.5)
    return scored.select(
        "id", "label", _between("prediction_score").alias("in_range"), consistent.alias("consistent"), "model_version"
    )


@query(
    f"""SELECT id, CAST(code AS DOUBLE) AS label, TRUE AS sure, TRUE AS named FROM class42 WHERE {_TESTED}"""
)
def tree_classes(spark, sf_dir):
    """An entropy tree trained on most attack flows classifies the rest."""
    train, test = split(labelled_attacks(spark, sf_dir), [0.8, 0.2])
    columns, _ = drop_correlated(train, ATTACK_PROFILE.columns)
    scaling = fit_robust(train, columns)
    model = train_tree(scale(train, scaling), columns)
    bundle = ModelBundle(model, tuple(columns), tuple(ATTACK_LABELS), scaling, metadata={"version": "tree"})
    scored = score_attack(test, bundle)
    name = F.element_at(F.array(*[F.lit(x) for x in ATTACK_LABELS]), F.col("attack_type_encoded") + 1)
    sure = (F.col("confidence") > 1 / len(ATTACK_LABELS)) & (F.col("confidence") <= 1)
    return scored.select("id", "label", sure.alias("sure"), (name == F.col("attack_type_name")).alias("named"))


@query(
    f"""SELECT id, CAST(is_attack AS DOUBLE) AS label, round(prediction_score, 9) AS rule, TRUE AS in_range, TRUE AS mean
    FROM threat WHERE {_TESTED}"""
)
def network_scores(spark, sf_dir):
    """A dense network and the rule score vote on the test flows."""
    train, test = split(labelled_threats(spark, sf_dir), [0.8, 0.2])
    scaling = fit_standard(train, _COLS)
    model = train_mlp(scale(train, scaling), _COLS)
    bundle = ModelBundle(model, tuple(_COLS), ("Normal", "Attack"), scaling, metadata={"version": "network"})
    network = score_threat(test, bundle).withColumnRenamed("prediction_score", "network").drop("is_attack", "threshold", "model_version")
    voted = soft_vote(rule_threat_score(network).withColumnRenamed("prediction_score", "rule"), ["network", "rule"])
    mean = F.abs(F.col("prediction_score") * 2 - F.col("network") - F.col("rule")) < 1e-9
    return voted.select("id", "label", F.round("rule", 9).alias("rule"), _between("network").alias("in_range"), mean.alias("mean"))


def _report_facts(report, floor: float):
    """Per line of a report its support, whether its figures are shares, and whether the accuracy reaches ``floor``."""
    shares = _between("precision") & _between("recall") & _between("f1")
    reached = (F.col("class") != "accuracy") | (F.col("f1") >= floor)
    return report.select("class", F.col("support").cast("bigint").alias("support"), shares.alias("shares"), reached.alias("reached"))


def _support_sql(counts: str) -> str:
    return f"""WITH c AS ({counts}) SELECT "class", support, TRUE AS shares, TRUE AS reached FROM c
    UNION ALL SELECT l, (SELECT sum(support) FROM c), TRUE, TRUE
    FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(l)"""


@query(
    _support_sql(
        f"""SELECT CASE WHEN is_attack THEN '1.0' ELSE '0.0' END AS "class", count(*) AS support
        FROM threat WHERE {_TESTED} GROUP BY 1"""
    )
)
def threat_training_report(spark, sf_dir):
    """The whole threat recipe: encode, eliminate features, scale, train, evaluate."""
    flows = labelled_threats(spark, sf_dir).join(
        V.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type"), "id"
    )
    named = flows.withColumn("class", F.when(F.col("label") == 1, "anomaly").otherwise("normal")).drop("label")
    _, results = train_threat_detector(named)
    return _report_facts(results["report"], 0.8)


_CODED = """SELECT a.id, dense_rank() OVER (ORDER BY attack_type_name) - 1 AS code FROM attack a"""


@query(
    f"""SELECT CAST(sum(support) AS BIGINT) AS tested, TRUE AS shares, TRUE AS reached FROM
    (SELECT code, count(*) AS support FROM ({_CODED}) WHERE {_TESTED} GROUP BY 1)"""
)
def attack_training_report(spark, sf_dir):
    """The whole attack recipe: clean, encode the label, drop correlated features, scale, train, evaluate."""
    flows = rule_attack_class(V.flow42(spark, sf_dir)).select("id", *ATTACK_PROFILE.columns, F.col("attack_type_name").alias(" Label"))
    _, results = train_attack_classifier(flows)
    facts = _report_facts(results["report"], 0.5)  # the rules draw among some classes by a digest
    return facts.agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("support"))).alias("tested"),
        F.min("shares").alias("shares"),
        F.min("reached").alias("reached"),
    )


@query(f"""SELECT id, TRUE AS same, 'kept' AS model_version FROM threat WHERE {_TESTED}""")
def bundle_round_trip(spark, sf_dir):
    """A model with its scaling, written and read again, scores as before."""
    train, test = split(labelled_threats(spark, sf_dir), [0.8, 0.2])
    scaling = fit_robust(train, _COLS)
    bundle = ModelBundle(
        train_forest(scale(train, scaling), _COLS, trees=5, depth=5), tuple(_COLS), ("Normal", "Attack"), scaling,
        metadata={"version": "kept"},
    )
    path = scratch_path(spark, "bundle")
    save_bundle(bundle, path, spark)
    before = score_threat(test, bundle).withColumnRenamed("prediction_score", "before").drop("is_attack", "threshold", "model_version")
    after = score_threat(before, load_bundle(spark, path))
    return after.select("id", (F.col("before") == F.col("prediction_score")).alias("same"), "model_version")


@query(
    """SELECT CAST(count(*) AS BIGINT) AS rows, 3 AS kept, TRUE AS has_the_deciding_one FROM events"""
)
def eliminated_features(spark, sf_dir):
    """Recursive elimination keeps the feature that alone decides the label."""
    flows = V.flow10(spark, sf_dir).withColumn("label", (F.col("count") > 250).cast("double"))
    left = rfe(flows, _COLS, "label", 3, trees=10, depth=5)
    return flows.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(left)).alias("kept"), F.lit("count" in left).alias("has_the_deciding_one")
    )


_BY_PORT = "CASE WHEN destination_port < 50 THEN 2 WHEN destination_port < 1000 THEN 1 ELSE 0 END"


@query(f"SELECT id, {_BY_PORT} AS code FROM flow42 WHERE {_TESTED}")
def separable_tree_classes(spark, sf_dir):
    """Classes that one feature tells apart are learnt without an error."""
    flows = V.flow42(spark, sf_dir).withColumn("label", F.expr(_BY_PORT).cast("double"))
    train, test = split(flows, [0.8, 0.2])
    bundle = ModelBundle(train_tree(train, ATTACK_PROFILE.columns), tuple(ATTACK_PROFILE.columns), ("c0", "c1", "c2"))
    return score_attack(test, bundle).select("id", F.col("attack_type_encoded").alias("code"))


@query("""SELECT id, "count" > 255.5 AS is_attack, 'threat_current' AS profile FROM flow10""")
def current_profile_scores(spark, sf_dir):
    """The default profile, which has no rules, scored by a model trained on it."""
    columns = THREAT_CURRENT.columns
    flows = V.flow10(spark, sf_dir).select("id", *columns)
    labelled = flows.withColumn("label", (F.col("count") > 255.5).cast("double"))
    bundle = ModelBundle(train_tree(labelled, columns), tuple(columns), ("Normal", "Attack"))
    scorer = ProfileScorer(THREAT_CURRENT, bundle)
    upload = score_frame(flows.drop("id").withColumns({c: F.col(c).cast("string") for c in columns}), policy=DROP, scorers=[scorer])
    key = [c for c in columns if c != "id"]
    scored = upload.scored.select(*key, "is_attack").distinct()
    return flows.join(scored, key).select("id", "is_attack", F.lit(upload.profile.name).alias("profile"))


@query(
    """SELECT id, id % 5 <> 0 AND id % 7 <> 0 AS scored, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS refused
    FROM flow10"""
)
def rows_a_model_cannot_take(spark, sf_dir):
    """NaN goes to quarantine before scoring, a null feature gets no score; neither ends the job."""
    flows = V.flow10(spark, sf_dir).select("id", *_COLS)
    labelled = flows.withColumn("label", (F.col("count") > 250).cast("double"))
    scorer = ProfileScorer(THREAT_LEGACY, ModelBundle(train_tree(labelled, _COLS), tuple(_COLS), ("Normal", "Attack")))
    odd = flows.withColumn(
        "src_bytes",
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("src_bytes")),
    ).withColumn("errors", F.array().cast("array<string>"))
    good, bad = validate(with_number_errors(odd, scorer), THREAT_LEGACY, DROP)
    scored, left_out = unscored(scorer.transform(good))
    parts = scored.select("id", F.lit(True).alias("scored"), F.lit(0).alias("refused"))
    parts = parts.unionByName(left_out.select("id", F.lit(False).alias("scored"), F.lit(0).alias("refused")))
    return parts.unionByName(bad.select("id", F.lit(False).alias("scored"), F.size("errors").alias("refused")))


@query(
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type END AS known, count(*) AS rows,
    event_type IN ('click', 'view') AS scored FROM events GROUP BY 1, 3"""
)
def unseen_words(spark, sf_dir):
    """Words the encoder has not seen give no score."""
    events = V.read_table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_type") == "view").cast("double").alias("label"))
    seen = events.where(F.col("event_type").isin("click", "view"))
    encoder = fit_encoder(seen, ["event_type"])
    model = train_tree(encode(seen, encoder, ["event_type"]), ["event_type", "value"], depth=3)
    bundle = ModelBundle(model, ("event_type", "value"), ("Normal", "Attack"), encoder=encoder, encoded=("event_type",))
    scored = score_threat(events, bundle)
    return scored.groupBy(
        F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("known"),
        F.col("prediction_score").isNotNull().alias("scored"),
    ).agg(F.count("*").alias("rows")).select("known", "rows", "scored")


# -- generated flows: draws differ, their shape does not --------------------------------------


@query(
    """SELECT n, CAST(n AS BIGINT) AS normal, 10 AS features, TRUE AS ranges FROM (SELECT count(*) AS n FROM events)"""
)
def generated_threats(spark, sf_dir):
    """As many generated normal and abnormal flows as there are events: their numbers and ranges."""
    n = V.read_table(spark, sf_dir, "events").count()
    rows = gen_threat(spark, n, n)
    low = F.when(F.col("class") == "normal", F.col("same_srv_rate").between(0.7, 1)).otherwise(F.col("same_srv_rate").between(0, 0.3))
    return rows.agg(
        (F.count("*") / 2).cast("bigint").alias("n"),
        F.count(F.when(F.col("class") == "normal", 1)).alias("normal"),
        F.lit(len(rows.columns) - 1).alias("features"),
        F.min(low & (F.col("src_bytes") >= 0) & (F.col("count") >= 0)).alias("ranges"),
    )


@query("SELECT count(*) AS n, 14 AS labels, 42 AS features, TRUE AS spread FROM orders")
def generated_attacks(spark, sf_dir):
    """As many generated attack flows as there are orders: labels, features and their spread."""
    n = V.read_table(spark, sf_dir, "orders").count()
    rows = gen_attack(spark, n)
    first = rows.columns[0]
    return rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("` Label`").cast("int").alias("labels"),
        F.lit(len(rows.columns) - 1).alias("features"),
        F.stddev(f"`{first}`").between(800, 1200).alias("spread"),
    )
