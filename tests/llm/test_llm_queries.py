"""The registered queries against their SQL on the smallest tables, and their columns."""

from __future__ import annotations

import pytest
from compare import connect, differences

from panelkite.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1": "doc_id held_out score predicted", "op2": "doc_id n_lines n_dropped kept_sha256",
    "op3": "doc_id size text_crc32 law shard slot grown_shard",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5": "doc_id n_shingles component_id",
    "op6": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10": "doc_id held_out lang_pred score",
    "op11": "doc_id held_out score predicted",
    "op12": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def test_one_query_per_operator(spark, sf_dir):
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf_dir, name):
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(QUERIES[name](spark, sf_dir).columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir) == ""
