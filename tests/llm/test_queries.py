"""Every query of the training-data problems runs on the smallest tables, and those
with SQL give the same rows."""

import oracle_tools
import pytest

from lexloom.llm import oracle, queries

COLUMNS = {
    "p1_found": ["seg_id", "orig_start", "trans_start"], "p3_found": ["seg_id", "defect"], "p4_found": ["doc_id", "line_no", "noise"], "p5_found": ["seg_id", "side", "start_pos", "end_pos"],
    "p6_found": ["doc_id", "block_no", "lang_code"], "p7_found": ["field", "doc_id", "seg_index"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "residue"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, oracle_tools.DATA)
    assert COLUMNS.get(name, df.columns) == df.columns
    rows = df.toPandas()
    if name.endswith("_found"):
        assert not rows.duplicated().any()
    if name in oracle.SQL:
        assert oracle_tools.difference(rows, oracle_tools.run_sql(oracle.SQL[name])) == ""
