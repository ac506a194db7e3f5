"""Every query against its SQL, and the shape of those without."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from fleetframe.llm.oracles import ORACLES
from fleetframe.llm.queries import QUERIES
from workload.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "classifier", "host_posterior", "path_posterior", "score", "predicted"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op7_decontamination": {"doc_id", "item_id", "similarity", "first_word", "n_words", "distance"},
    "op8_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_html": {"page_id", "url", "text", "n_chars"},
    "op11_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op12_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert set(QUERIES[name](spark, SF_DIR).columns) == COLUMNS[name]
