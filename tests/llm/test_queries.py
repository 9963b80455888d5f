"""The registered queries: against their SQL where they have one, and the columns they promise."""

import os

import pytest

from flowward.llm.queries import ORACLES, QUERIES
from oracle_check import TESTDATA, compare, connect

SF_DIR = f"{TESTDATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")

COLUMNS = {
    "op3_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_near_dups": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op11_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string",
    "op12_role_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string",
    "op13_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns(spark, name):
    found = dict(QUERIES[name](spark, SF_DIR).dtypes)
    wanted = dict(c.split(" ") for c in COLUMNS[name].split(", "))
    assert {c: found.get(c) for c in wanted} == wanted


def test_held_out_accuracy_of_languages(spark):
    found = QUERIES["op5_language_id"](spark, f"{TESTDATA}/sf0.01")
    truth = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_packing_needs_few_sequences(spark):
    rows = QUERIES["op8_packing"](spark, f"{TESTDATA}/sf0.01").collect()
    used = len({r.sequence_id for r in rows})
    assert used <= -(-sum(r.length for r in rows) // 4096) + 3
