"""Registered queries against their DuckDB SQL, and the contract's columns."""

import __spark_entry__ as e
from ledgerlake.llm import queries
from ledgerlake.plans.oracle import check
from tests.conftest import SF_CHECK, SF_SMALL

COLUMNS = {
    "op1": ["doc_id", "text", "n_entities"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4": ["doc_id", "size", "source_size", "target", "taken"],
    "op5": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9": ["page_id", "host", "path", "rule", "verdict"],
    "op10": ["query_id", "rank", "vec_id", "score"],
    "op11": ["item_id", "rank", "doc_id", "score"],
    "op12": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op13": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_sql_agrees(spark):
    failures = [(n, m) for n, status, _, _, m in check(spark, SF_CHECK, list(queries.ORACLE_SQL)) if status != "ok"]
    assert not failures, failures


def test_registered_with_the_contracts_columns(spark):
    found = e.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found)
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)
    for name in ("op11_lexical", "op12_packing", "op13_alignment", "op3_sharding", "op4_mixing", "op6_warc", "op7_secrets", "op8_decontamination", "op9_host_reputation"):
        df = found[name](spark, SF_SMALL)
        want = COLUMNS[name.split("_")[0]]
        assert df.columns[:len(want)] == want, name
