"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as engine
from compare_oracle import TABLES, canonical
from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    theirs = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(ours.columns, [tuple(r) for r in ours.collect()]) == theirs


def test_entry(spark):
    assert engine.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(engine.queries())
