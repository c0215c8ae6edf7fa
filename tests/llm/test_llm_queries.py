"""Every pN_ query runs on the smallest tables; those with SQL twins equal them."""

from pathlib import Path

import pytest

from quern.llm import queries, sql

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

COLUMNS = {
    "p1_found": ["doc_id", "item_id"], "p2_found": ["source_table", "id_a", "id_b"], "p3_found": ["row_id", "kind"], "p4_found": ["source_table", "id_a", "id_b"],
    "p5_found": ["source_table", "id_a", "id_b"], "p6_found": ["target_field", "category"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
        if "id_a" in df.columns:
            assert all(r.id_a < r.id_b for r in rows)
    if name in sql.oracle_sql():
        import duckdb

        c = duckdb.connect()
        for f in DATA.iterdir():
            c.execute(f"create view {f.stem} as from '{f}'")
        assert sorted(map(tuple, rows)) == sorted(c.execute(sql.oracle_sql()[name]).fetchall())
