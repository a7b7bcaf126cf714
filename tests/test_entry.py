import glob
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import compare


def test_keys_and_entry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    assert entry.entry(spark).count() >= 0


def test_core_stands_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("recordspark.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "recordspark.llm", None)
    names = entry.queries()
    assert "p6_found" in names and "p4_found" not in names


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, small, name):
    got, want = entry.queries()[name](spark, small).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and compare.rows(got) == compare.rows(want)
