import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "cloud_principal_axes" in oracles


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["n"] > 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["ew_ieee_divide", "reduce_rows_argmin", "exclusive_scan", "coo_to_csr", "spmv", "eigh3_reconstructs", "svd_tall_reconstructs"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    expected = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    columns = sorted(expected.columns)
    key = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert sorted(got.columns) == columns and key(got).equals(key(expected))
