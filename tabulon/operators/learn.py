"""Class-weighted forests with group folds, calibration and spread over trees."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import formulas
from tabulon.functions.semantics import is_finite
from tabulon.operators import geometry
from tabulon.operators.evaluate import stratified_folds
from tabulon.operators.trees import Grower, binned
from tabulon.workspace import Workspace


def eligible(df: DataFrame, group: str, label: str, rows: int = 30, per_class: int = 5, groups: int = 2) -> None:
    """Raises if there are too few labelled rows, rows of a class, or groups of a class."""
    known = df.where(F.col(label).isin(0, 1))
    by = {r[0]: (r[1], r[2]) for r in known.groupBy(label).agg(F.count(F.lit(1)), F.count_distinct(group)).collect()}
    total = sum(n for n, _ in by.values())
    if total < rows:
        raise RuntimeError(f"only {total} labeled rows; {rows} are needed")
    for c in (0, 1):
        n, g = by.get(c, (0, 0))
        if n < per_class or g < groups:
            raise RuntimeError(f"class {c} has {n} rows in {g} groups; {per_class} rows in {groups} groups are needed")


def assembled(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a feature vector, and rows with an unusable feature."""
    good = F.lit(True)
    for f in features:
        good = good & is_finite(F.col(f).cast("double"))
    ready = df.where(good)
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready), df.where(~good)


def structure_features(df: DataFrame, id_: str, structure: str, spacegroup: str, properties: dict[str, list[float]] | None = None) -> tuple[DataFrame, list[str]]:
    """(id, 32 features) of structures, and the features' names: 12 of the cell (atoms, elements, volume per atom, density, least
    distance, space group, lengths, angles) and four statistics of each of five element properties.

    All within a structure's row but the least distance, which is joined by id. Null where there is no structure or an
    element is unknown.
    """
    cell = [F.col(f"{structure}.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
    elements = F.transform(f"{structure}.sites", lambda s: s["element"])
    kinds = F.array_sort(F.array_distinct(elements))
    counts = F.transform(kinds, lambda k: F.size(F.filter(elements, lambda e: e == k)))
    stats = formulas.composition_statistics(kinds, counts, properties)
    atoms, v = F.size(elements), geometry.volume(*cell)
    own = {
        "atom_count": atoms.cast("double"), "element_count": F.size(kinds).cast("double"), "volume_per_atom": v / atoms, "density": stats["mass_weighted_mean"] * atoms * 1.66053907 / v, "min_distance": F.col("least_distance"), "spacegroup_number": F.col(spacegroup).cast("double"),
        **dict(zip(("lattice_a", "lattice_b", "lattice_c", "alpha", "beta", "gamma"), cell)),
    }
    near = geometry.least_distance(df, id_, structure)
    rows = df.select(id_, structure, spacegroup).join(near, id_, "left")
    every = own | stats
    return rows.select(id_, *[c.alias(n) for n, c in every.items()]), list(every)


def save_bundle(spark: SparkSession, path: str, model: RandomForestClassificationModel, features: list[str], metrics: dict) -> None:
    """A model with the names of its features and its metrics, to be read by ``load_bundle``."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(features, json.dumps(metrics, sort_keys=True))], "features array<string>, metrics string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> tuple[RandomForestClassificationModel, list[str], dict]:
    about = spark.read.schema("features array<string>, metrics string").json(f"{path}/about").first()
    return RandomForestClassificationModel.load(f"{path}/model"), list(about["features"]), json.loads(about["metrics"])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over twice the rows of the class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total)) / (2 * F.col("__n"))).drop("__n")  # one row a class


def forest(label: str, trees: int, seed: int) -> RandomForestClassifier:
    # each row's nodes are kept between the levels, else every level leads it through all trees again; the trees are the same
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=8, minInstancesPerNode=2, seed=seed, cacheNodeIds=True)


def _read(path: str, columns: list[str]) -> pa.Table:
    """Columns of a staged table, by a worker; its files in the order of their names."""
    where, root = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=where, use_threads=False, partitioning=None) for f in files])


def _whole_trees(spark: SparkSession, ws: Workspace, rows: DataFrame, id_: str, label: str, features: list[str], folds: list[int], trees: int, seed: int) -> DataFrame:
    """(id, label, fold, probability): each tree is grown by one task, which reads a byte a row and feature of the staged rows."""
    at, few, many = rows._staged_at, 50, 100_000  # trees a task, rows a result
    start = range(0, trees, few)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for j in (j for pdf in batches for j in pdf["id"]):
            own = _read(at, ["fold", label, features[j]])
            held, y, column = (own[c].to_numpy() for c in ("fold", label, features[j]))
            yield pd.DataFrame({"feature": [j], **{f"c{k}": [c.tobytes()] for k, c in zip(folds, binned(column, y.astype(np.uint8), held, folds))}})

    codes = ws.stage(spark.range(0, len(features), 1, len(features)).mapInPandas(bins, "feature long, " + ", ".join(f"c{k} binary" for k in folds)))
    codes_at = codes._staged_at

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in (t for pdf in batches for t in pdf["id"]):
            k, first = folds[task % len(folds)], start[task // len(folds)]
            own = _read(at, ["fold", label])
            held, y = (own[c].to_numpy() for c in ("fold", label))
            column = _read(codes_at, ["feature", f"c{k}"]).sort_by("feature")[f"c{k}"]
            grower = Grower([np.frombuffer(c.as_buffer(), np.uint8) for c in column], y.astype(np.uint8), np.flatnonzero(held != k), np.flatnonzero(held == k))
            sums = np.zeros(len(y))
            for t in range(first, min(first + few, trees)):
                grower.add(sums, np.random.default_rng([seed, k, t]))
            sums = sums[held == k]
            for chunk in range(0, len(sums), many):
                yield pd.DataFrame({"fold": [k], "chunk": [chunk], "first": [first], "sums": [sums[chunk : chunk + many].tobytes()]})

    grown = ws.stage(spark.range(0, len(folds) * len(start), 1, len(folds) * len(start)).mapInPandas(grow, "fold int, chunk long, first long, sums binary"))

    def mean(key: tuple, parts: pa.Table) -> pa.Table:
        k, chunk = (x.as_py() for x in key)
        own = _read(at, [id_, label, "fold"])
        own = own.filter(pc.equal(own["fold"], k)).slice(chunk, many)
        sums = sum(np.frombuffer(s.as_buffer()) for s in parts.sort_by("first")["sums"])
        return own.append_column("probability", pa.array(sums / trees))

    return grown.groupBy("fold", "chunk").applyInArrow(mean, rows.select(id_, label, "fold").withColumn("probability", F.lit(0.0)).schema)


def _shared_trees(rows: DataFrame, id_: str, label: str, features: list[str], folds: list[int], trees: int, seed: int) -> DataFrame:
    """The same by Spark's forests, of which every task has a part of the rows."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    parts = []
    for k in folds:
        model = forest(label, trees, seed + k).fit(weighted(rows.where(F.col("fold") != k), label))
        parts.append(model.transform(rows.where(F.col("fold") == k)).select(id_, label, "fold", vector_to_array("probability")[1].alias("probability")))
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(spark: SparkSession, df: DataFrame, id_: str, group: str, label: str, features: list[str], folds: int = 5, trees: int = 400, seed: int = 20, most: int = 4_000_000) -> DataFrame:
    """(id, label, fold, probability, calibrated): each row scored by forests that never saw its group, then Platt scaled.

    Up to ``most`` rows each tree is grown by one task from a byte a row and feature; more rows go through Spark's forests, which take far longer but share the rows.
    Workers read staged files themselves, so pyarrow must know the file system of ``spark.checkpoint.dir``.
    """
    df = Workspace(spark, "rows").stage(df)  # read many times from here on
    eligible(df, group, label)
    ready, _ = assembled(df.where(F.col(label).isin(0, 1)), features)
    ws = Workspace(spark, "folds")
    fold_of = ws.stage(stratified_folds(ready, group, label, folds))
    total, known = fold_of.agg(F.sum("rows"), F.sort_array(F.collect_set("fold"))).first()  # at most ``folds`` values
    rows = ready.join(fold_of.select(group, "fold"), group).select(id_, F.col(label).cast("double").alias(label), "fold", *[F.col(f).cast("double").alias(f) for f in features])
    rows = ws.stage(rows.repartition(max(8, total // 250_000), id_).sortWithinPartitions(id_))  # the order of rows decides on their draws
    if total <= most:
        scored = ws.stage(_whole_trees(spark, ws, rows, id_, label, features, known, trees, seed))
    else:
        scored = ws.stage(_shared_trees(rows, id_, label, features, known, trees, seed))
    platt = LogisticRegression(labelCol=label, featuresCol="p", predictionCol="pred", probabilityCol="pc", rawPredictionCol="raw", regParam=1e-3)
    scored = VectorAssembler(inputCols=["probability"], outputCol="p").transform(scored)
    return platt.fit(scored).transform(scored).select(id_, F.col(label).cast("int").alias(label), "fold", "probability", vector_to_array("pc")[1].alias("calibrated"))


def leaf_probabilities(spark: SparkSession, model: RandomForestClassificationModel) -> np.ndarray:
    """Probability of label 1 by tree and leaf, leaves counted from left to right as by ``leafCol``; at most 2 ** depth a tree, whatever the data."""
    path = f"{Workspace(spark, 'forest').root}/model"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild < 0").select("treeID", "id", "impurityStats").collect()
    out = np.zeros((model.getNumTrees, 1 << model.getMaxDepth()))
    seen = [0] * len(out)
    for tree, _, stats in sorted(nodes, key=lambda n: (n[0], n[1])):  # nodes are numbered in preorder
        out[tree, seen[tree]] = stats[1] / sum(stats)
        seen[tree] += 1
    return out


def scored_with_uncertainty(spark: SparkSession, df: DataFrame, id_: str, label: str, features: list[str], trees: int = 100, seed: int = 20) -> DataFrame:
    """(id, probability, uncertainty, error): mean and population deviation over trees; rows with unusable features only have an error."""
    ready, bad = assembled(Workspace(spark, "rows").stage(df), features)
    train = weighted(ready.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias(label), "features"), label)
    model = forest(label, trees, seed).fit(train)
    votes = leaf_probabilities(spark, model)
    leaves = model.setLeafCol("leaf").transform(ready.select(id_, "features")).select(id_, vector_to_array("leaf", "float32").alias("leaf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cast = votes[np.arange(len(votes)), np.stack(pdf["leaf"].to_numpy()).astype(np.int64)]
                yield pd.DataFrame({id_: pdf[id_], "probability": cast.mean(axis=1), "uncertainty": cast.std(axis=1)})

    kind = df.schema[id_].dataType.simpleString()
    good = leaves.mapInPandas(run, f"{id_} {kind}, probability double, uncertainty double").withColumn("error", F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    return good.unionByName(bad.select(id_, none.alias("probability"), none.alias("uncertainty"), F.lit("unusable feature").alias("error")))
