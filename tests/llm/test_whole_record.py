"""The surviving record has a value in every column in which some row of its group has one."""

import datetime as dt
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabulon.llm.survivors import candidate_rows, p4_survivors, read, surviving_records

DATA = "/root/testdata/sf0.001"


def test_votes_for_numbers_flags_and_times(spark):
    d, nan = [dt.datetime(2025, 10, 26, 0, 59, k) for k in (1, 2, 3)], float("nan")
    rows = [
        ("a", 1, True, d[0], "n", nan, None, None), ("a", 2, False, d[1], "n", -2.5, 9, True), ("a", 3, False, d[2], "n", 10.1 + 0.2, 9, False), ("a", 4, False, None, "n", 1.0, 10, False),
        ("b", 5, True, d[0], "n", 1.0, 9, None), ("b", 6, False, d[1], "n", 2.0, 10, None), ("c", 7, False, d[0], "n", nan, 10, True), ("c", 8, False, d[0], "n", nan, 9, True),
    ]
    frame = spark.createDataFrame(rows, "grp string, id long, ok boolean, at timestamp, name string, value double, weight int, flag boolean")
    others = [("value", "double"), ("weight", "int"), ("flag", "boolean"), ("at", "timestamp")]
    out = surviving_records(spark, frame, "grp", "id", F.col("ok"), "at", ["name"], others, others)
    got = {r[0]: tuple(r[1:]) for r in out.select("group_id", "row_id", *[read(F.col("best")[c], k).alias(c) for c, k in others]).collect()}
    assert got == {"a": (1, 10.1 + 0.2, 9, False, d[0]), "b": (5, 1.0, 9, None, d[0]), "c": (7, None, 9, True, d[0])}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_no_column_of_the_record_stays_empty(spark):
    rows, columns = candidate_rows(spark, DATA)
    members = {}
    for r in rows.where("full_candidate IS NOT NULL").collect():
        members.setdefault(r["full_candidate"], []).append(r)
    there = lambda v: v is not None and not (isinstance(v, float) and math.isnan(v))
    out = p4_survivors(spark, DATA).collect()
    assert len(out) == sum(len(m) > 1 for m in members.values()) > 0
    for r in out:
        for c, _ in columns:
            if c not in ("dft_row_id", "candidate_id"):
                known = [m[c] for m in members[r["candidate_id"]] if there(m[c])]
                assert r[f"best_{c}"] in known if known else r[f"best_{c}"] is None
