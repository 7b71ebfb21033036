"""Driver contract: entry() and the registry against DuckDB at sf0.001."""

import os

import pytest

import __spark_entry__ as E
from linkwright.plans import queries as Q

SMOKE = "/root/testdata/sf0.001"


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke data")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.where("similarity > 0.8").count() == df.count() > 100
    assert df.columns == ["address1_id", "address1", "address2_id", "address2", "similarity"]


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke data")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    got = E.queries()[name](spark, SMOKE).toPandas()
    exp = con.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)

    import pandas as pd

    def cell(v):
        if v is None or (not isinstance(v, (list, dict, tuple)) and pd.isna(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v

    def norm(df):
        df = df[sorted(df.columns)]
        return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False)),
                      key=repr)
    assert norm(got) == norm(exp)


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke data")
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SMOKE)
    rows = df.toPandas()
    assert len(rows) > 0 and list(rows.columns) == df.columns
    if name == "fuzzy_lookup":  # misspelt inputs find the city they were made from
        assert rows["matched"].mean() > 0.9 and (rows["city"] != rows["best_match"]).mean() > 0.9
    if "similarity" in rows:
        assert rows["similarity"].between(0.8, 1.0).all()
