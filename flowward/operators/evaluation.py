"""Classifier evaluation over prediction rows; only class- or score-level counts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowward.operators.recent import running_totals


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows per (true, predicted) pair."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count("*").alias("count"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: list) -> DataFrame:
    """The confusion counts with one column per predicted class, zeros included.

    ``other`` counts the predictions that are in none of ``classes``, null included.
    """
    counts = [F.count(F.when(F.col(pred) == c, 1)).alias(str(c)) for c in classes]
    listed = F.coalesce(F.col(pred).isin(list(classes)), F.lit(False))
    return df.groupBy(F.col(label).alias("label")).agg(*counts, F.count(F.when(~listed, 1)).alias("other"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision, recall, f1 and support per class, then rows for accuracy, macro avg and weighted avg."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(zero)

    def part(cls: str, support: Column, predicted: Column, correct: Column) -> Column:
        return F.struct(
            F.col(cls).cast("string").alias("class"),
            support.alias("support"),
            predicted.alias("predicted"),
            correct.alias("correct"),
        )

    sides = F.array(part("label", F.col("count"), zero, hit), part("prediction", zero, F.col("count"), zero))
    per_class = (
        confusion(df, label, pred)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
        .withColumns(
            {
                "precision": _ratio(F.col("correct"), F.col("predicted")),
                "recall": _ratio(F.col("correct"), F.col("support")),
            }
        )
        .withColumn(
            "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )
    metrics = ("precision", "recall", "f1")
    summed = per_class.rollup("class").agg(
        F.grouping("class").alias("_total"),
        F.sum("support").alias("support"),
        F.sum("correct").alias("correct"),
        *[F.avg(m).alias(m) for m in metrics],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in metrics],
    )
    accuracy = _ratio(F.col("correct"), F.col("support"))

    def line(name: Column, *values: Column) -> Column:
        return F.struct(
            name.alias("class"),
            *[v.alias(m) for m, v in zip(metrics, values)],
            F.col("support").alias("support"),
        )

    plain = [F.col(m) for m in metrics]
    lines = F.when(
        F.col("_total") == 1,
        F.array(
            line(F.lit("accuracy"), accuracy, accuracy, accuracy),
            line(F.lit("macro avg"), *plain),
            line(F.lit("weighted avg"), *[F.col(f"w_{m}") for m in metrics]),
        ),
    ).otherwise(F.array(line(F.col("class"), *plain)))
    return summed.select(F.inline(lines))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Share of rows whose prediction is the label."""
    right = F.count(F.when(F.col(label) == F.col(pred), 1))
    return df.agg(_ratio(right, F.count("*")).alias("accuracy"))


def _score_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score from high to low: positives and negatives with it, and running counts.

    ``label`` is true or 1 for the positive class.
    """
    positive = F.col(label).cast("int") == 1
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg")
    )
    return running_totals(per_score, [F.col("threshold").desc()], {"tp": "pos", "fp": "neg"})


def _totals(points: DataFrame) -> tuple[Column, Column]:
    """All positives and all negatives, each as a one-row subquery."""
    return tuple(points.agg(F.sum(c).alias(c)).scalar() for c in ("pos", "neg"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, after a first point (infinity, 0, 0)."""
    points = _score_points(df, label, score)
    pos, neg = _totals(points)
    curve = points.select("threshold", _ratio(F.col("fp"), neg).alias("fpr"), _ratio(F.col("tp"), pos).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores share one step."""
    points = _score_points(df, label, score)
    pos, neg = _totals(points)
    height = F.col("tp").cast("double") - F.col("pos").cast("double") / 2
    area = F.sum(F.col("neg").cast("double") * height)
    return points.agg(area.alias("area")).select(
        F.try_divide("area", pos.cast("double") * neg.cast("double")).alias("auc")
    )


def evaluate(df: DataFrame, label: str, pred: str, score: str | None = None) -> dict[str, DataFrame]:
    """accuracy, report and confusion, plus ROC and AUC when a score is given."""
    out = {
        "accuracy": accuracy(df, label, pred),
        "report": classification_report(df, label, pred),
        "confusion": confusion(df, label, pred),
    }
    if score is not None:
        out |= {"roc": roc_curve(df, label, score), "auc": auc(df, label, score)}
    return out
