import glob
import os

import duckdb
import pytest

from tapquarry.plans import catalogue

SF = "/root/testdata/sf0.001"
con = duckdb.connect()
for f in glob.glob(f"{SF}/*.parquet"):
    con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_duckdb(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns, want = sorted(df.columns), con.sql(catalogue.ORACLES[name])
    names = want.columns
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_entry_imports_without_the_corpus_part():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
