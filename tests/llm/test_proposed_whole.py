"""No sure pattern is left out, however many there are."""

from pyspark.sql import functions as F

from tabulon.llm.pii import _han_patterns, proposed_names


def test_more_sure_patterns_than_are_sent_to_the_workers(spark):
    texts = ["计算由司马娜负责,第一批", "审核由秦岭完成,第二批", "计算由秦岭负责", "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {p for t, i, j in ((texts[0], 3, 6), (texts[1], 3, 5), (texts[2], 3, 5)) for p in _han_patterns(t, i, j)[:2]}
    rows = [("name", p, 0.9, 5) for p in near] + [("name", f"other {i}", 0.95, 100 + i) for i in range(30)] + [("name", "weak", 0.5, 900), ("phone", "else", 0.9, 900)]
    patterns = spark.createDataFrame(rows, "class string, pattern string, p double, n long").withColumn("pattern", F.xxhash64("pattern"))
    whole = sorted(tuple(r) for r in proposed_names(spark, docs, patterns).collect())
    assert {(r[0], r[4]) for r in whole} >= {(0, "司马娜"), (1, "秦岭"), (2, "秦岭")} and all(abs(r[5] - 0.45) < 1e-9 for r in whole)
    for most in (0, 3, 20):
        got = proposed_names(spark, docs, patterns, most=most)
        assert sorted(tuple(r) for r in got.collect()) == whole
    assert proposed_names(spark, docs, patterns.limit(0), most=0).count() == 0
