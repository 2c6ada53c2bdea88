"""Forests whose trees are each grown by one task: the trees of Spark, all rows scored, whatever the layout of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import learn
from tabulon.operators.trees import Grower, binned, cuts


def test_a_tree_without_draws_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 5000), 30 * rng.random(5000), rng.integers(0, 90, 5000) ** 2 // 2700]).astype(float)
    y = (rng.random(5000) < 0.1 + 0.05 * x[0] + 0.2 * (x[1] > 11) - 0.05 * x[2] * (x[0] > 4)).astype(int)
    df = spark.createDataFrame([(k, float(y[k]), *map(float, x[:, k])) for k in range(5000)], "id long, label double, a double, b double, c double")
    ready, _ = learn.assembled(df, ["a", "b", "c"])
    model = DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=4, minInstancesPerNode=2).fit(learn.weighted(ready.where("id < 4000"), "label"))
    wanted = dict(model.transform(ready.where("id >= 4000")).select("id", vector_to_array("probability")[1]).collect())
    fold = (np.arange(5000) >= 4000).astype(int)
    codes = [binned(c, y.astype(np.uint8), fold, [1])[0] for c in x]
    sums = np.zeros(5000)
    Grower(codes, y.astype(np.uint8), np.arange(4000), np.arange(4000, 5000), depth=4, per_node=3).add(sums, rng, bootstrap=False)
    assert not sums[:4000].any() and len(set(wanted.values())) > 5
    assert sums[4000:] == pytest.approx([wanted[k] for k in range(4000, 5000)])


def test_bins_are_quantiles_of_the_other_folds():
    assert cuts(np.array([1.0, 2.0, 4.0]), np.array([1, 1, 1])).tolist() == [1.5, 3.0]
    column, fold, label = np.random.default_rng(1).random(6400), np.arange(6400) % 2, np.arange(6400) // 2 % 2
    column[fold == 1] *= 100  # of no weight where fold 1 is held out
    zero, one = binned(column, label, fold, [0, 1])
    assert np.bincount(one[fold == 0]).tolist() == [100] * 32 and np.bincount(zero[fold == 1]).tolist() == [100] * 32
    assert (one[column > 1] == 31).all()
    assert binned(np.full(5, 2.0), label[:5], np.zeros(5, int), [1])[0].tolist() == [0] * 5
    assert cuts(np.arange(40.0), np.array([100.0] + [1.0] * 39)).tolist()[:3] == [0.5, 1.5, 2.5]  # after a heavy value the next ones, as Spark has it


def test_every_row_is_scored_by_trees_of_one_task_each(spark, monkeypatch):
    df = spark.range(0, 600, 1, 3).select("id", (F.col("id") % 40).cast("string").alias("grp"), F.rand(1).alias("a"), (F.col("id") % 7 + F.rand(2)).alias("b")).withColumn("label", (F.col("a") + F.rand(3) > 1).cast("int"))
    df = spark.createDataFrame(df.collect(), df.schema)
    asked = (spark, df, "id", "grp", "label", ["a", "b"], 3, 60)
    shared = {r.id: r for r in learn.out_of_fold(*asked, most=0).collect()}
    monkeypatch.setattr(learn, "forest", None)  # Spark's forests lead all rows through all trees at once
    got = {r.id: r for r in learn.out_of_fold(*asked).collect()}
    again = {r.id: r for r in learn.out_of_fold(spark, df.orderBy(F.desc("id")).repartition(5), *asked[2:]).collect()}
    assert sorted(got) == list(range(600)) and all(0 <= r.probability <= 1 and 0 < r.calibrated < 1 for r in got.values())
    assert all((got[k].fold, got[k].probability) == (again[k].fold, again[k].probability) for k in got)
    assert all((got[k].fold, got[k].label) == (shared[k].fold, shared[k].label) for k in got)
    assert np.corrcoef([got[k].probability for k in range(600)], [shared[k].probability for k in range(600)])[0, 1] > 0.9  # as of two seeds
