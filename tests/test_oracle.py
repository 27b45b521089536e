"""Every registered query with an oracle equals its DuckDB SQL at sf0.001
(the driver repeats this at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

from paths import SF001
import __spark_entry__ as E
from riskflow.bindings import TABLES

QUERIES = E.queries()
SQL = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF001).toPandas()
    dd = con.execute(SQL[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert _rows(sp) == _rows(dd)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) > 5
    assert df.count() >= 0
