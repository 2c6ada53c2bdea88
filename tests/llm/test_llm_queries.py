"""The registered queries of the subpackage on the smallest data, against their SQL where there is one."""

import math
from pathlib import Path

import pytest

from tabulon.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, DATA)
    wanted = duck.sql(queries.ORACLE[name])
    order = sorted(frame.columns)
    assert order == sorted(wanted.columns)
    take = lambda rows, columns: sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)
    assert take(frame.collect(), frame.columns) == take(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", ["p2_overlap_report", "p5_links", "p7_space_report", "p8_share_report", "p1_split_report"])
def test_reports(spark, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]
    assert rows
    for r in rows:
        if name == "p2_overlap_report":
            assert 0 <= r["overlapping"] <= r["rows"] and r["pairs"] >= r["overlapping"] and 0 <= r["coverage"] <= 1
        elif name == "p7_space_report":
            assert r["containers"] >= max(r["least_by_tokens"], r["least_by_pieces"]) and 0 <= r["unused_share"] < 0.2
        elif name == "p8_share_report":
            assert r["most_uses"] <= r["max_repeats"] and 0 <= r["actual_share"] <= 1
        elif name == "p5_links":
            assert (r["confidence"] is None) == (r["records"] > 1)
        else:
            assert r["rows"] > 0 and 0 <= r["label_share"] <= 1
