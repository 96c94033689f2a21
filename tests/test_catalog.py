"""Registered queries against SQL, at the smallest scale; and the entry points."""

import os

import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, want = catalog.queries()[name](spark, FOLDER), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_read_only_what_they_need(spark):
    df = catalog.queries()["flagship_brands"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "p_name" not in plan and "c_name" not in plan
    plan = catalog.queries()["filter_has_p"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal" in plan and "o_orderkey" not in plan
