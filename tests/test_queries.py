"""Every registered graph query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from fjordgraph.plans import catalog, structured  # noqa: F401
from fjordgraph.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    return c


def shown(rows, names):
    keys = sorted(names)
    cell = lambda v: "~" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[names.index(k)]) for k in keys) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(rel.fetchall(), list(rel.columns))


def test_entry_lists_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
