"""The queries of the training-text operators run on the small tables and keep their columns."""

import pytest

import weftline.llm.queries  # noqa: F401
from weftline import catalog

COLUMNS = {
    "p4_found": ["table_name", "row_key", "place_id"], "p5_found": ["pair_kind", "our_key", "other_key"], "p6_found": ["field_name", "row_key", "elem_no"],
    "p7_found": ["link_kind", "left_key", "elem_no", "person_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind", "span_start", "span_end"],
    "p9_mix": ["doc_id", "source", "n_tokens", "rate", "copies", "posteriors"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert df.count() > 0


def test_every_document_has_ids(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = catalog.QUERIES["p8_ids"](spark, data)
    assert ids.count() == docs.count() and ids.filter("ids is null").count() == 0
