"""Query registry and the shared building blocks of the check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.profiles import ACTIONS, ATTACK_LABELS, ATTACK_PROFILE, THREAT_LEGACY, action_for
from flowward.sources.flow_views import FLOW10, FLOW42, MESSAGES, WHITELIST, select_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name; ``sql`` may use the names in `BASE`."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_zone(fn(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = with_base(sql)
        return fn

    return register


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as plain wall-clock values, which every engine reads alike."""
    return df.select(
        *[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def _md5(columns: list[str]) -> str:
    return "md5(concat(" + ", ".join(f"printf('%.6f', {c})" for c in columns) + "))"


def _half(start: int, m: int) -> str:
    return f"CAST(CAST('0x' || substr(h, {start}, 16) AS UBIGINT) % {m} AS BIGINT)"


def _mod(m: int) -> str:
    return f"(({_half(1, m)} * {2**64 % m} + {_half(17, m)}) % {m})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return quoted(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_ACTION_ROWS = [
    (n, action_for(n)[0], action_for(n)[1], ACTIONS[n][2], ACTIONS[n][3]) for n in ACTIONS
]

# Named building blocks of the check SQL, each resting on earlier ones.
BASE = {
    "flow10": select_sql(FLOW10, "events"),
    "flow42": select_sql(FLOW42, "orders"),
    "messages": select_sql(MESSAGES, "events"),
    "whitelist": "SELECT DISTINCT * FROM (" + select_sql(WHITELIST, "events") + ")",
    "labels14": f"SELECT * FROM ({values(list(enumerate(ATTACK_LABELS)))}) t(code, label)",
    "actions14": f"SELECT * FROM ({values(_ACTION_ROWS)}) t(label, action_type, action_description, pkey, pvalue)",
    "hash10": f"SELECT *, {_md5(THREAT_LEGACY.columns)} AS h FROM flow10",
    "score10": f"""SELECT *, {_mod(20)} AS noise,
        CASE WHEN "count" / CAST(500 AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN CAST(0.3 AS DOUBLE) ELSE 0 END
        + CASE WHEN same_srv_rate < CAST(0.3 AS DOUBLE) OR same_srv_rate > CAST(0.95 AS DOUBLE)
               THEN CAST(0.2 AS DOUBLE) ELSE 0 END
        + CASE WHEN diff_srv_rate > CAST(0.5 AS DOUBLE) THEN CAST(0.25 AS DOUBLE) ELSE 0 END
        + CASE WHEN dst_host_srv_count / CAST(255 AS DOUBLE) > CAST(0.7 AS DOUBLE) THEN CAST(0.25 AS DOUBLE) ELSE 0 END
        + CASE WHEN src_bytes / CAST(10000 AS DOUBLE) > CAST(0.8 AS DOUBLE)
                 OR dst_bytes / CAST(10000 AS DOUBLE) > CAST(0.8 AS DOUBLE)
               THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS raw
        FROM hash10""",
    "threat": """SELECT id, id AS traffic_data_id, created_at, prediction_score,
        prediction_score > CAST(0.5 AS DOUBLE) AS is_attack, CAST(0.5 AS DOUBLE) AS threshold,
        'ensemble_v1' AS model_version
        FROM (SELECT id, created_at, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE),
            least(CASE WHEN raw = 0 THEN CAST(0.1 AS DOUBLE) ELSE raw END, CAST(0.95 AS DOUBLE))
            + CAST(noise AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS prediction_score FROM score10)""",
    "hash42": f"SELECT *, {_md5(ATTACK_PROFILE.columns)} AS h FROM flow42",
    "class42": f"""SELECT *, CASE WHEN destination_port = 21 THEN 4 WHEN destination_port = 22 THEN 7
        WHEN destination_port IN (80, 443, 8080) AND psh_flag_count > 0 AND ack_flag_count > 10
            THEN CASE {_mod(3)} WHEN 0 THEN 9 WHEN 1 THEN 11 ELSE 12 END
        WHEN flow_packets_per_s > 1000 AND total_fwd_packets > 100 THEN 2
        WHEN flow_packets_per_s > 1000
            THEN CASE {_mod(4)} WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 8 END
        WHEN fin_flag_count > 0 AND rst_flag_count > 0 AND flow_duration < 1000 THEN 3
        WHEN flow_bytes_per_s > 5000 AND flow_bytes_per_s < 50000 AND ack_flag_count > 5 THEN 10
        WHEN flow_duration > 100000 AND flow_bytes_per_s > 100 THEN 13 ELSE 0 END AS code,
        round(CAST(0.75 AS DOUBLE) + CAST({_mod(25)} AS DOUBLE) / CAST(100 AS DOUBLE), 2) AS confidence
        FROM hash42""",
    "attack": """SELECT c.id, c.id AS traffic_data_id, c.created_at, c.code AS attack_type_encoded,
        l.label AS attack_type_name, c.confidence, 'decision_tree_v1' AS model_version
        FROM class42 c JOIN labels14 l ON l.code = c.code""",
    "action": """SELECT a.id, a.id AS attack_prediction_id, a.created_at, d.action_type, d.action_description,
        d.pkey, d.pvalue, 'logged' AS status, a.created_at AS execution_time
        FROM attack a JOIN actions14 d ON d.label = a.attack_type_name""",
    "traffic": "SELECT f.id, f.created_at, m.source, m.batch_id FROM flow10 f JOIN messages m ON m.id = f.id",
    "complete": """SELECT t.id, t.created_at, t.source, t.batch_id, p.id AS threat_id, p.created_at AS threat_at,
        p.prediction_score, p.is_attack, a.id AS attack_id, a.attack_type_name, a.confidence, x.action_type
        FROM traffic t LEFT JOIN threat p ON p.traffic_data_id = t.id
        LEFT JOIN attack a ON a.traffic_data_id = t.id LEFT JOIN action x ON x.attack_prediction_id = a.id""",
    # Live messages of both record types; ids are interleaved to stay unique.
    "live": """SELECT id * 2 AS id, id * 2 AS traffic_data_id, created_at, prediction_score, is_attack,
        CAST(NULL AS VARCHAR) AS attack_type_name, CAST(NULL AS DOUBLE) AS confidence,
        CAST(NULL AS VARCHAR) AS action_description FROM threat
        UNION ALL SELECT a.id * 2 + 1, a.id * 2 + 1, a.created_at, NULL, NULL, a.attack_type_name, a.confidence,
        x.action_description FROM attack a JOIN action x ON x.attack_prediction_id = a.id""",
}


def with_base(sql: str) -> str:
    """Put the building blocks that ``sql`` names, directly or not, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BASE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BASE[name])

    visit(sql)
    blocks = [f"{name} AS ({BASE[name]})" for name in BASE if name in needed]
    if not blocks:
        return sql
    body = sql.lstrip()
    joiner = ", " + body[5:] if body.upper().startswith("WITH ") else " " + body
    return "WITH " + ", ".join(blocks) + joiner
