"""Every plan with an SQL counterpart gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pricelake.plans.registry import ORACLES, PLANS
from tools.check_oracle import TABLES, rows_of

SQL = ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_sql(spark, sf, duck, name):
    df = PLANS[name](spark, sf)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(SQL[name])
    want, wanted = rows_of([d[0] for d in duck.description], duck.fetchall())
    assert columns == wanted
    assert got == want


def test_every_plan_has_sql():
    assert set(PLANS) == set(SQL)
    assert PLANS.items() <= queries().items() and SQL.items() <= oracle_sql().items()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_no_forbidden_calls():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "pricelake")
    banned = ("localCheckpoint", "crossJoin(", "toPandas(", ".rdd", "broadcast(")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert not [b for b in banned if b in text], name
