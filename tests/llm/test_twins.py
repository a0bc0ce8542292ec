"""Registered queries against their SQL twins, and the schema that each contract names."""

import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES
from plumbline.validation import differences, oracle

# Columns and types of the contracts.
COLUMNS = {
    "op1_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op3_feistel_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op4_chat_masks": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op5_media_sequences": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op6_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op7_near_duplicates": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op8_decontamination": "doc_id:bigint item_id:bigint edits:bigint item_words:bigint",
    "op9_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op10_html_text": "page_id:bigint url:string text:string n_chars:bigint",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    ours = [r.asDict() for r in QUERIES[name](spark, sf).collect()]
    assert differences(ours, oracle(sf, ORACLE_SQL[name])) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_of_the_contract(spark, sf, name):
    df = QUERIES[name](spark, sf)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split():
        key, _, kind = column.partition(":")
        assert types.get(key) == kind, (key, types)
    assert df.count() > 0
