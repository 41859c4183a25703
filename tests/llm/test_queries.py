import math

import pytest

from siftwell import llm

#: The columns of each query's contract.
COLUMNS = {
    "op1": "doc_id held_out lang_pred score", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op3": "page_id payload_bytes payload_digest record_type refers_to",
    "op4": "doc_id n_shingles component_id kept", "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "query_id rank doc_id score", "op7": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset", "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "doc_id size source_size target taken",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op12": "doc_id start n_tokens ids_crc32", "op13": "vec_id component n deviation whitened explained identity_error",
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_columns(spark, sf, name):
    assert set(COLUMNS[name.partition("_")[0]].split()) <= set(llm.queries()[name](spark, sf).columns)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = llm.queries()[name](spark, sf)
    want = duck.execute(llm.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    assert sorted(repr([plain(r[c]) for c in cols]) for r in got.collect()) == sorted(repr(list(map(plain, r))) for r in want.fetchall())
