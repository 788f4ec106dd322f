"""The queries of the training-data operators: SQL where there is some, columns everywhere."""

import pytest

from docmark.llm.queries import ORACLE, QUERIES
from tests.support import differences

COLUMNS = {
    "op2_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op4_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op5_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op7_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
}


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, name, sf_dir) == []


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_has_the_columns_and_rows(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert set(got.columns) >= COLUMNS[name] and got.count() > 0


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    packed = QUERIES["pipeline"](spark, sf_dir)
    assert packed.select("doc_id").distinct().count() > 100
