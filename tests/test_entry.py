"""The driver contract: entry() smoke run, every query against its DuckDB
twin on the smallest check tables, and plan properties of the registered
queries."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="check tables not present")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple("" if x is None else x for x in t))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["device", "stage_order", "funnel_stage", "unique_users"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(entry.reference_queries()) == set(entry.reference_oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_do_without_the_optional_part(monkeypatch):
    """Missing without a word; broken, or lacking a library, with a warning."""
    assert entry._optional("tidemark.nothing_here.queries") is None
    real = entry.importlib.import_module

    def lacking(name):
        raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")

    monkeypatch.setattr(entry.importlib, "import_module", lacking)
    with pytest.warns(UserWarning, match="xxhash"):
        assert entry._optional("tidemark.llm.queries") is None
    monkeypatch.setattr(entry.importlib, "import_module", real)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.reference_queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.reference_queries()[name](spark, SF)
    got = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = duck.execute(entry.reference_oracles()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(sdf.columns)
    assert got == _canon(cols, cur.fetchall())
