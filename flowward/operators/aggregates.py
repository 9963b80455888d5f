"""Dashboard aggregates. Each is one grouped aggregate, reduced per task before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowward.functions.labels import heat_level
from flowward.operators.joins import recent_complete, tables_of_batch
from flowward.operators.quantiles import exact_quantiles
from flowward.operators.recent import top_recent
from flowward.profiles import ATTACK_LABELS, label_dim

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def threat_stats(threat: DataFrame) -> DataFrame:
    """total, attacks, normal and attack_rate (percent, two decimals, 0 when empty)."""
    return rated(threat.agg(F.count("*").alias("total"), _count_if(F.col("is_attack")).alias("attacks")))


def rated(counts: DataFrame) -> DataFrame:
    """``counts`` (total, attacks) with the normal rows and the attack rate."""
    return counts.select(
        "total",
        "attacks",
        (F.col("total") - F.col("attacks")).alias("normal"),
        F.round(_percent(F.col("attacks"), F.col("total")), 2).alias("attack_rate"),
    )


def attack_distribution(attack: DataFrame) -> DataFrame:
    """Predictions per attack name."""
    return attack.groupBy("attack_type_name").agg(F.count("*").alias("count"))


def action_distribution(action: DataFrame) -> DataFrame:
    """Actions per type."""
    return action.groupBy("action_type").agg(F.count("*").alias("count"))


def distribution_total(dist: DataFrame) -> DataFrame:
    """Sum of a distribution's counts (benign rows included)."""
    return dist.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def dense_distribution(attack: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A count for every class, zeros included."""
    dim = label_dim(attack.sparkSession, tuple(ATTACK_LABELS)) if labels is None else labels
    return (
        dim.join(attack_distribution(attack), "attack_type_name", "left")
        .select("attack_type_encoded", "attack_type_name", F.coalesce("count", F.lit(0)).alias("count"))
    )


def distribution_map(dist: DataFrame, key: str) -> DataFrame:
    """One row with a distribution as ``map<string,bigint>`` (one entry per class or action type)."""
    return dist.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))).alias("distribution"))


def prediction_stats(tables: dict[str, DataFrame], n: int = 20) -> dict[str, DataFrame]:
    """Totals, attack distribution and newest composite rows of the stats page."""
    return {
        "totals": threat_stats(tables["threat"]),
        "distribution": attack_distribution(tables["attack"]),
        "recent": recent_complete(tables, n),
    }


def list_batches(traffic: DataFrame) -> DataFrame:
    """Upload batches with row count and upload time, newest first."""
    return (
        traffic.where((F.col("source") == "upload") & F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.count("*").alias("row_count"), F.min("created_at").alias("uploaded_at"))
        .orderBy(F.col("uploaded_at").desc(), F.col("batch_id"))
    )


def upload_summary(tables: dict[str, DataFrame], batch_id: str) -> DataFrame:
    """Totals of one upload: any row with an attack prediction, benign or not, counts as an attack."""
    own = tables_of_batch(tables, batch_id)
    traffic = own["traffic"].select(F.col("id").alias("_key"))
    threat = own["threat"].select(F.col("traffic_data_id").alias("_key"), "is_attack")
    attack = own["attack"].select(F.col("traffic_data_id").alias("_key"), F.lit(True).alias("_has_attack"))
    rows = traffic.join(threat, "_key", "left").join(attack, "_key", "left")
    has_attack = F.coalesce("_has_attack", F.lit(False))
    flagged = F.coalesce("is_attack", F.lit(False))
    counts = rows.agg(
        F.count("*").alias("total"),
        _count_if(flagged | has_attack).alias("attacks"),
        _count_if(F.col("is_attack").isNotNull() & ~flagged & ~has_attack).alias("normal"),
    )
    return upload_rate(counts)


def upload_rate(counts: DataFrame) -> DataFrame:
    """``counts`` with the attack rate of an upload, which is not rounded."""
    return counts.withColumn("attack_rate", _percent(F.col("attacks"), F.col("total")))


def rolling_stats(messages: DataFrame, n: int = 100) -> DataFrame:
    """Stats over the ``n`` newest messages; one without a score counts as score 0 and as normal."""
    counts = top_recent(messages, n).agg(
        F.count("*").alias("total"),
        _count_if(F.col("is_attack")).alias("attacks"),
        F.coalesce(F.avg(F.coalesce("prediction_score", F.lit(0.0))), F.lit(0.0)).alias("avg_threat_score"),
    )
    return counts.select(
        "total", "attacks", (F.col("total") - F.col("attacks")).alias("normal"), "avg_threat_score"
    )


def attack_heatmap(df: DataFrame) -> DataFrame:
    """Attacks per weekday and hour on the full 7 x 24 grid, with a heat level per cell."""
    # Counted, not filtered: a filter would move below the scoring and compute the score again.
    return heat_grid(df.groupBy(week_slot("created_at")).agg(_count_if(F.col("is_attack")).alias("n")))


def week_slot(time_col: str) -> Column:
    """The hour of the week, from Monday on."""
    return (F.weekday(time_col) * 24 + F.hour(time_col)).alias("slot")


def heat_grid(counts: DataFrame) -> DataFrame:
    """The 7 x 24 grid of ``counts`` (slot, n), at most one row a slot."""
    spark = counts.sparkSession
    grid = spark.range(0, 168, 1, 1).select(F.col("id").cast("int").alias("slot"))
    cells = grid.join(F.broadcast(counts), "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("count"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    # 168 rows at most, so one window over all of them is fine.
    top = F.max("count").over(Window.partitionBy())
    return cells.select(
        F.get(names, F.floor(F.col("slot") / 24).cast("int")).alias("day"),
        (F.col("slot") % 24).alias("hour"),
        "count",
        heat_level(F.col("count"), top).alias("level"),
    )


def kpi_history(df: DataFrame, buckets: int = 12, time_col: str = "created_at") -> DataFrame:
    """Totals, attacks and attack rate in equal time buckets from first to last row, each with its trend in percent.

    Empty buckets are kept. The time span is a one-row aggregate, read as a scalar.
    """
    micros = F.unix_micros(F.col(time_col))
    span = df.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = F.greatest(F.ceil((hi - lo + 1) / F.lit(buckets)), F.lit(1))
    bucket = F.floor((micros - lo) / width).cast("int")
    counts = df.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("total"), _count_if(F.col("is_attack")).alias("attacks")
    )
    series = (
        df.sparkSession.range(0, buckets, 1, 1)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(F.broadcast(counts), "bucket", "left")
        .select(
            "bucket",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("attacks", F.lit(0)).alias("attacks"),
        )
        .withColumn("attack_rate", F.round(_percent(F.col("attacks"), F.col("total")), 2))
    )
    order = Window.orderBy("bucket")

    def trend(c: str) -> Column:
        previous = F.lag(c).over(order)
        return F.round(F.try_divide((F.col(c) - previous) * F.lit(100.0), previous), 2)

    return series.withColumns({f"{c}_trend": trend(c) for c in ("total", "attacks", "attack_rate")})


def throughput(df: DataFrame, width: str = "1 second", time_col: str = "created_at") -> DataFrame:
    """total, threats and normal per tumbling time window; rows without a threat prediction are normal."""
    counts = df.groupBy(F.window(time_col, width).alias("w")).agg(
        F.count("*").alias("total"), _count_if(F.col("is_attack")).alias("threats")
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        "total",
        "threats",
        (F.col("total") - F.col("threats")).alias("normal"),
    )


def registry_stats(models: DataFrame) -> DataFrame:
    """Per model type: count, bytes, active count and active version; both types always appear, plus the totals."""
    spark = models.sparkSession
    types = spark.sql("SELECT explode(array('threat_detector', 'attack_classifier')) AS model_type")
    size = F.coalesce("file_size_bytes", F.lit(0))
    per_type = models.groupBy("model_type").agg(
        F.count("*").alias("count"),
        F.sum(size).alias("size_bytes"),
        _count_if(F.col("is_active")).alias("active_count"),
        F.min_by(F.when(F.col("is_active"), F.col("version")), F.when(F.col("is_active"), F.col("id"))).alias(
            "active_version"
        ),
    )
    totals = models.agg(F.count("*").alias("total_models"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
    zero = F.lit(0).cast("bigint")
    return types.join(per_type, "model_type", "left").select(
        "model_type",
        *[F.coalesce(c, zero).alias(c) for c in ("count", "size_bytes", "active_count")],
        "active_version",
        totals.select("total_models").scalar().alias("total_models"),
        totals.select("total_bytes").scalar().alias("total_bytes"),
        F.round(totals.select("total_bytes").scalar() / F.lit(1024.0 * 1024.0), 2).alias("total_mb"),
    )


def whitelist_count(dim: DataFrame, active_only: bool = False) -> DataFrame:
    """Number of entries, all or active."""
    counted = _count_if(F.col("is_active")) if active_only else F.count("*")
    return dim.agg(counted.alias("count"))


def latency_summary(df: DataFrame, col: str) -> DataFrame:
    """Mean and exact 95th percentile of a measurement column."""
    p95 = exact_quantiles(df, [col], [0.95]).select("value")
    return df.agg(F.avg(col).alias("mean")).select("mean", p95.scalar().alias("p95"))
