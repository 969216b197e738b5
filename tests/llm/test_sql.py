"""Queries for training data against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracemill.llm import queries

D = "/root/testdata/sf0.001"


def plain(df):
    value = lambda x: None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else x.item() if isinstance(x, np.generic) else x
    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), c.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
