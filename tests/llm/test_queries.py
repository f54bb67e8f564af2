"""The registered queries: their columns, and DuckDB where SQL can say the same."""

import pytest

from acrely.llm.queries import ORACLE, QUERIES
from checks.compare import agree, oracle_connection

COLUMNS = {
    "op1": "doc_id n_shingles component_id", "op2": "doc_id held_out score predicted", "op3": "doc_id license coverage",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id keep_id group_size kept text_sha256", "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id held_out lang_pred score", "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "doc_id size source_size target taken", "op10": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11": "page_id payload_bytes payload_digest record_type refers_to", "op12": "doc_id n_features weight score rank",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    found = QUERIES[name](spark, data).toPandas()
    wanted = COLUMNS[name.split("_")[0]].split()
    assert list(found.columns)[:len(wanted)] == wanted and not found[wanted[0]].duplicated().any()
    if name in ORACLE:
        assert agree(found, oracle_connection(data).sql(ORACLE[name]).df()) is None
    else:
        assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count()


def test_all_are_there():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)
