"""Every query of the subpackage runs on the smallest tables and keeps its columns."""

import os

import pytest

from weftline.llm import registry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["raw_id", "side", "markup", "element"],
    "p3_found": ["src", "row_id", "pos"],
    "p4_found": ["pair_id", "defect"],
    "p5_found": ["pick_id", "label"],
    "p6_found": ["system", "rank_no"],
    "p7_found": ["bitext_id", "source_idx", "translation_idx"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert name == "p8_ids" or len({tuple(r) for r in rows}) == len(rows)
