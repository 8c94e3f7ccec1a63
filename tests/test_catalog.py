"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tapeloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str | bool) else round(float(v), 6)

    return names, sorted(map(repr, [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())
