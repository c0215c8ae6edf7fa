"""Every query runs on the smallest tables; those with SQL twins equal them."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(round(v, 6)) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in DATA.iterdir():
        c.execute(f"create view {f.stem} as from '{f}'")
    return c


CORE = sorted(k for k in entry.queries() if not (k[0] == "p" and k[1:2].isdigit()))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = db.execute(sql)
    at = {c[0]: k for k, c in enumerate(r.description)}
    assert sorted(at) == names
    assert got == sorted((tuple(_value(row[at[n]]) for n in names) for row in r.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_runs_without_llm():
    """Nothing outside the subpackage names it."""
    root = Path(entry.__file__).parent / "quern"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quern.llm" not in f.read_text(), os.fspath(f)
