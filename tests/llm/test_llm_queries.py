"""Registered queries of the subpackage run over the smallest tables with a stable schema."""

import pytest

from lumenveil.llm.queries import QUERIES

FOUND = {
    "p1_found": ["file_id"],
    "p3_found": ["group_hit_id", "hit_id"],
    "p6_found": ["scan_id", "file_path"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


#: p1_repairs is exact and takes minutes for single texts; test_parse_errors.py tests it on small ones.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"p1_repairs"}))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    rows = df.count()
    assert rows > 0
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert df.dropDuplicates().count() == rows
