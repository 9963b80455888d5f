"""One query per operator over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowward.llm.alignment import alignment_digests
from flowward.llm.bpe import encoded_digests
from flowward.llm.decontaminate import decontaminate
from flowward.llm.languages import identify
from flowward.llm.line_dedup import dedup_lines
from flowward.llm.near_dups import near_duplicates
from flowward.llm.packing import pack_documents
from flowward.llm.quality import judge
from flowward.llm.quotes import link_quotes
from flowward.llm.role_repair import repair_digests
from flowward.llm.secret_scan import scan_secrets
from flowward.llm.token_counts import count_tokens
from flowward.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.array_join(F.col("removed_lines").cast("array<string>"), ",")
    return found.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), removed.alias("removed"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(_table(spark, sf_dir, "documents"))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(_table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dups": op4_near_dups,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_quotes": op10_quotes,
    "op11_alignment": op11_alignment,
    "op12_role_repair": op12_role_repair,
    "op13_bpe": op13_bpe,
    "pipeline": corpus_pipeline.run,
}

# The shortest windows of 50 words from each line on and up to each line; a window's lines go where the same
# lines stood before.
LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, line, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line,
               unnest(string_split(text, chr(10))) AS x FROM documents)),
p AS (
  SELECT *, row_number() OVER w AS pos, sum(words) OVER w AS upto, sum(words) OVER w - words AS since
  FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
spans AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos
  WHERE b.upto - a.since >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos
  WHERE b.upto - a.since >= 50 GROUP BY b.doc_id, b.pos),
w AS (
  SELECT spans.doc_id, s, e, string_agg(x, chr(10) ORDER BY pos) AS content
  FROM spans JOIN p ON p.doc_id = spans.doc_id AND pos BETWEEN s AND e GROUP BY 1, 2, 3),
f AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY content) AS earliest FROM w),
gone AS (
  SELECT DISTINCT p.doc_id, p.line FROM f JOIN p ON p.doc_id = f.doc_id AND p.pos BETWEEN f.s AND f.e
  WHERE (f.doc_id, f.s) > f.earliest),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY 1),
t AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.line) AS text
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY 1)
SELECT d.doc_id, CASE WHEN n IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text,
       coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPS_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, na.n, nb.n
  HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(root) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (
  SELECT item, least(len(w), 13) AS width, i, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM t),
x AS (
  SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS g
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
m AS (SELECT x.doc_id, x.width, x.i AS p, t.item, t.i AS item_at FROM x JOIN t ON t.g = x.g AND t.width = x.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS p FROM m) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
runs AS (
  SELECT doc_id, item, min(p) AS p, min(item_at) AS item_at, count(*) + min(width) - 1 AS n
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, p - item_at ORDER BY p) AS island FROM m)
  GROUP BY doc_id, item, p - item_at, island),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item, item_at) AS k FROM runs)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated,
       coalesce(n, 0) AS longest_match, p - 1 AS match_start, item AS match_item, item_at - 1 AS match_item_start
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op4_near_dups": NEAR_DUPS_SQL,
    "op6_decontamination": DECONTAMINATION_SQL,
}
