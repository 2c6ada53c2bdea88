"""The registered queries on the smallest data against their SQL."""

import math
from pathlib import Path

import pytest

from tabulon.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def normal(rows, columns):
    order = sorted(columns)

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[columns.index(c)]) for c in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    wanted = duck.sql(catalogue.ORACLE[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert normal([tuple(r) for r in frame.collect()], frame.columns) == normal(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", ["balanced_assignment", "system_keys", "leader_clusters"])
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
