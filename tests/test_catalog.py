"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from turnwise.plans import catalog, oracle

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


def plain(v):
    """A value in a form that compares and sorts across engines."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cur.description], cur.fetchall())


#: Queries without SQL; test_learning.py and test_what_if.py hold their operators against plain versions.
LEARNED = {"principal_components", "linear_probe", "shortcut_answers", "counterfactual_pairs"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | LEARNED


def test_bootstrap_interval_holds_the_mean(spark):
    rows = QUERIES["cluster_bootstrap"](spark, DATA).collect()
    assert rows
    for r in rows:
        low, high = sorted(v for k, v in r.asDict().items() if k in ("low", "high"))
        assert 0 <= low <= high <= 1
