"""The four linked result tables, the dimension tables, and JSON and CSV outputs."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from flowward.operators.dashboards import CELLS, load_cells, load_newest, newest_schema
from flowward.operators.features import pack_features
from flowward.operators.joins import upload_load
from flowward.operators.scoring import ACTION_COLUMNS, ATTACK_COLUMNS, THREAT_COLUMNS, action_rows, attach_actions
from flowward.operators.sets import union_all
from flowward.profiles import ATTACK, THREAT, FeatureProfile
from flowward.session import cut_lineage, discard, remove_path
from flowward.sources.manifest import Snapshot, commit, forgotten, snapshot

SCHEMAS = {
    "traffic_data": "id bigint, created_at timestamp, features map<string,double>, batch_id string, "
    "source string, load_id string",
    "threat_predictions": "id bigint, traffic_data_id bigint, created_at timestamp, prediction_score double, "
    "is_attack boolean, threshold double, model_version string, source string, load_id string",
    "attack_predictions": "id bigint, traffic_data_id bigint, created_at timestamp, attack_type_encoded int, "
    "attack_type_name string, confidence double, model_version string, source string, load_id string",
    "self_healing_actions": "id bigint, attack_prediction_id bigint, created_at timestamp, action_type string, "
    "action_description string, action_params map<string,string>, status string, execution_time timestamp, "
    "error_message string, source string, load_id string",
}
RESULT_TABLES = tuple(SCHEMAS)
SCHEMAS |= {"dashboard_cells": CELLS, "newest_predictions": newest_schema(SCHEMAS)}
DASHBOARD_NAMES = {"cells": "dashboard_cells", "newest": "newest_predictions"}
SHORT_NAMES = {
    "traffic": "traffic_data",
    "threat": "threat_predictions",
    "attack": "attack_predictions",
    "action": "self_healing_actions",
}


def load_table(spark: SparkSession, name: str, root: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A result table: parquet under ``root``, or any format by options, e.g. JDBC.

    A table that nothing was written to yet is empty. It reads the folders of the store's newest version: loads that
    are not committed are not in it, later loads and compactions do not change it.
    """
    if fmt != "parquet":
        return spark.read.format(fmt).options(**({"dbtable": name} | options)).load()
    if name not in SCHEMAS:
        return spark.read.parquet(f"{root}/{name}")
    return read_folders(spark, name, root, snapshot(spark, root))


def read_folders(spark: SparkSession, name: str, root: str, state: Snapshot) -> DataFrame:
    """The rows of a result table in one version of a store."""
    schema = SCHEMAS[name]
    if not state.version:
        return _plain_table(spark, name, root)
    folders = state.of_table(name)
    parts = []
    whole = [f"{root}/data/{f}/{name}" for f, folder in folders.items() if not folder.others]
    if whole:
        parts.append(spark.read.schema(schema).parquet(*whole))
    for f, folder in folders.items():
        if folder.others:  # rows of loads that have been written anew since
            table = spark.read.schema(schema).parquet(f"{root}/data/{f}/{name}")
            parts.append(table.where(~F.col("load_id").isin(sorted(folder.others))))
    return union_all(*parts) if parts else spark.createDataFrame([], schema)


def _plain_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A table without a log: one folder, partitioned in any way."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def load_tables(spark: SparkSession, root: str, batch_id: str | None = None) -> dict[str, DataFrame]:
    """All four result tables by their short names, in one version of the store.

    With ``batch_id`` only the folders that hold that upload are read; other loads compacted with it are still there.
    """
    state = snapshot(spark, root)
    if batch_id is not None:
        own = {upload_load(batch_id, kind) for kind in (THREAT, ATTACK)}
        state = Snapshot(state.version, {name: f for name, f in state.folders.items() if f.loads & own})
    return {short: read_folders(spark, name, root, state) for short, name in SHORT_NAMES.items()}


def load_dashboard(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What the dashboards merge, by loads: ``cells`` and ``newest`` (see `flowward.operators.dashboards`)."""
    state = snapshot(spark, root)
    return {short: read_folders(spark, name, root, state) for short, name in DASHBOARD_NAMES.items()}


def result_rows(scored: DataFrame, profile: FeatureProfile) -> dict[str, DataFrame]:
    """The rows each result table gets from scored rows of one profile.

    A prediction belongs to one traffic row, so it takes over that row's id.
    """
    base = ["created_at", "source", "load_id"]
    out = {
        "traffic_data": pack_features(scored, profile).select("id", "features", "batch_id", *base),
    }
    link = [F.col("id"), F.col("id").alias("traffic_data_id")]
    if profile.model_type == THREAT:
        out["threat_predictions"] = scored.select(*link, *THREAT_COLUMNS, *base)
    else:
        attacks = scored.select(*link, *ATTACK_COLUMNS, *base)
        out["attack_predictions"] = attacks
        out["self_healing_actions"] = action_rows(attacks, keep=("source", "load_id"))
    return out


def write_scored(scored: DataFrame, profile: FeatureProfile, root: str, load_id: str) -> None:
    """Store scored rows in the result tables, with the partial figures of the dashboards.

    A load is written to a folder of its own and then committed. Writing it again replaces what it wrote before, so
    a re-run or a replayed micro-batch leaves each row once; readers of an earlier version still see the earlier
    folder. The record type is part of the stored load id: a load may have rows of both types. Rows are scored once.
    """
    spark, name_of_load = scored.sparkSession, f"{load_id}-{profile.model_type}"
    own = None if hasattr(scored, "_cut_path") else cut_lineage(scored, "scored")
    rows = (scored if own is None else own).withColumn("load_id", F.lit(name_of_load))
    out = result_rows(rows, profile)
    out["dashboard_cells"] = load_cells(rows, profile)
    out["newest_predictions"] = load_newest(rows, profile)
    for name, df in out.items():
        check_types(df, name)
    folder = uuid.uuid4().hex
    # side by side: the small tables take hardly more time than their scheduling
    with ThreadPoolExecutor(len(out)) as pool:
        for written in [pool.submit(df.write.parquet, f"{root}/data/{folder}/{name}") for name, df in out.items()]:
            written.result()
    commit(spark, root, lambda _: {"add": {folder: ([name_of_load], sorted(out), [])}, "drop": []})
    if own is not None:
        discard(own)


def compact_tables(spark: SparkSession, root: str, into: str | None = None, below: int = 64) -> None:
    """Write folders of few loads anew as one, in place, or the whole store by source and day under ``into``.

    In place it takes the folders that have fewer than ``below`` loads, so that what was compacted before stays as it
    is, and commits the new one for the old: readers and loads go on beside it. A load that has been written anew
    meanwhile is left out of the new folder's loads.
    """
    if into is not None:
        for name in RESULT_TABLES:
            rows = load_table(spark, name, root).withColumn("event_date", F.to_date("created_at"))
            spread_rows = rows.hint("rebalance", "source", "event_date")
            spread_rows.write.mode("overwrite").partitionBy("source", "event_date").parquet(f"{into}/{name}")
        return
    state = snapshot(spark, root)
    chosen = {name: f for name, f in state.folders.items() if len(f.loads) < below}
    if len(chosen) < 2:
        return
    part = Snapshot(state.version, chosen)
    loads = frozenset().union(*[f.loads for f in chosen.values()])
    tables = sorted(frozenset().union(*[f.tables for f in chosen.values()]))
    new = uuid.uuid4().hex
    for name in tables:
        read_folders(spark, name, root, part).hint("rebalance").write.parquet(f"{root}/data/{new}/{name}")

    def change(now: Snapshot) -> dict | None:
        left = [name for name in chosen if name in now.folders]
        still = frozenset().union(*[now.folders[name].loads for name in left])
        return {"add": {new: (sorted(still), tables, sorted(loads - still))}, "drop": left} if still else None

    commit(spark, root, change)


def vacuum_tables(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Remove folders that none of the ``keep`` newest versions reads; gives their number."""
    old = forgotten(spark, root, keep)
    for name in old:
        remove_path(spark, f"{root}/data/{name}")
    return len(old)


def check_types(df: DataFrame, name: str) -> None:
    """Refuse rows whose columns are not of the types that table ``name`` stores."""
    wanted = {f.name: f.dataType for f in StructType.fromDDL(SCHEMAS[name]).fields}
    for field in df.schema.fields:
        if field.name in wanted and field.dataType.simpleString() != wanted[field.name].simpleString():
            raise TypeError(f"{name}.{field.name} is {field.dataType.simpleString()}, not {wanted[field.name].simpleString()}")


# -- dimensions --------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dim_versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Complete versions of a dimension table, oldest first."""
    path, fs = _fs(spark, f"{root}/{name}")
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"v(\d+)", status.getPath().getName())
        done, _ = _fs(spark, f"{root}/{name}/{status.getPath().getName()}/_SUCCESS")
        if m and fs.exists(done):
            found.append(int(m.group(1)))
    return sorted(found)


def write_dim(df: DataFrame, root: str, name: str) -> int:
    """Store a dimension table as its next version."""
    version = max(dim_versions(df.sparkSession, root, name), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    return version


def read_dim(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A dimension table, its newest complete version by default."""
    if version is None:
        versions = dim_versions(spark, root, name)
        if not versions:
            raise FileNotFoundError(f"{root}/{name}")
        version = versions[-1]
    return spark.read.parquet(f"{root}/{name}/v{version}")


# -- other outputs --------------------------------------------------------------------


def to_prediction_messages(df: DataFrame) -> DataFrame:
    """One JSON message per scored row: type, timestamp and the prediction data.

    ``df`` has traffic_data_id and created_at, and the threat, attack and action
    columns as structs (null where they do not apply); source and sender_ip are
    taken along where present.
    """
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    data = [at.alias("timestamp"), F.col("traffic_data_id")]
    data += [F.col(c) for c in ("source", "sender_ip") if c in df.columns]
    data += [
        F.col("threat").alias("threat_prediction"),
        F.col("attack").alias("attack_prediction"),
        F.col("action").alias("self_healing_action"),
    ]
    message = F.struct(F.lit("prediction").alias("type"), at.alias("timestamp"), F.struct(*data).alias("data"))
    return df.select(F.to_json(message, {"ignoreNullFields": "false"}).alias("value"))


def prediction_structs(scored: DataFrame, profile: FeatureProfile) -> DataFrame:
    """Scored rows of one profile in the shape `to_prediction_messages` takes."""
    null_threat = F.lit(None).cast("struct<id:bigint,prediction_score:double,is_attack:boolean,threshold:double>")
    null_attack = F.lit(None).cast("struct<id:bigint,attack_type_encoded:int,attack_type_name:string,confidence:double>")
    null_action = F.lit(None).cast(
        "struct<id:bigint,action_type:string,action_description:string,action_params:map<string,string>,status:string>"
    )
    extra = [F.col(c) for c in ("source", "sender_ip") if c in scored.columns]
    base = [F.col("id").alias("traffic_data_id"), F.col("created_at"), *extra]
    if profile.model_type == THREAT:
        threat = F.struct("id", *THREAT_COLUMNS[:3])
        return scored.select(*base, threat.alias("threat"), null_attack.alias("attack"), null_action.alias("action"))
    attack = F.struct("id", *ATTACK_COLUMNS[:3])
    action = F.struct("id", *ACTION_COLUMNS, F.lit("logged").alias("status"))
    return attach_actions(scored).select(*base, null_threat.alias("threat"), attack.alias("attack"), action.alias("action"))


def write_flows_json(df: DataFrame, fmt: str = "text", **options: str) -> None:
    """Publish rows as JSON: one message per row to Kafka, or one line per row to text files."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format(fmt).mode("append").options(**options).save()


def append_log_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV log; each part file carries the header."""
    write_csv(df, path, "append")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; blanks at the start of names and values are kept."""
    df.write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
