"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from shokuba.plans import classes, geography, panels, serving
from shokuba.plans import queries as plans

SF = "/root/testdata/sf0.001"
assert classes and geography and panels and serving  # they add to the queries
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(df, columns):
    def text(x):
        if x is None or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(text, row)) for row in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - {"grf05_page_rank", "grf07_closeness", "grf09_hub_ranking"}))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
