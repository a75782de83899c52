"""Classifiers on sample vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.cluster import fitting_input
from fluxloom.operators.distance import nearest_given
from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.operators.moments import group_sums



def centroids_long(flux: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group in long form; an absent cell counts as 0."""
    rows = flux.select(group, *ROW_KEY).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    sums = flux.groupBy(group, "reaction").agg(F.sum("flux").alias("s"))
    return sums.join(rows, group).select(group, "reaction", (F.col("s") / F.col("n_rows")).alias("mean"))


def centroids(rows: DataFrame, group: str, v: str = "v") -> DataFrame:
    """Mean vector of each group of dense rows: partial sums per task, then one vector per group."""
    return group_sums(rows, group, v).select(
        group, F.transform("total", lambda x: x / F.col("n")).alias("v"), "n")


def nearest_centroid(train: DataFrame, test: DataFrame, group: str, v: str = "v", out: str = "pred") -> DataFrame:
    """Predict the group of the nearest training mean; ties go to the least group. Any number of groups."""
    return nearest_given(test, v, centroids(train, group, v), group, "v", out)


def _fit_and_predict(classifier, train: DataFrame, test: DataFrame, group: str, v: str, out: str) -> DataFrame:
    """Fit on the training rows with classes numbered in sorted order, and name the predicted classes."""
    index = StringIndexer(inputCol=group, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    with fitting_input(index.transform(train), "y", v=v) as vectors:
        model = classifier(len(index.labels)).fit(vectors)
    found = model.transform(test.withColumn("features", array_to_vector(F.col(v))))
    names = IndexToString(inputCol="prediction", outputCol=out, labels=index.labels)
    return names.transform(found).drop("features", "rawPrediction", "probability", "prediction")


def random_forest(train: DataFrame, test: DataFrame, group: str = "label", max_depth: int = 2, seed: int = 0,
                  v: str = "v", out: str = "pred", trees: int = 100) -> DataFrame:
    """Random forest of shallow trees."""
    return _fit_and_predict(
        lambda _: RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=max_depth, seed=seed),
        train, test, group, v, out)


def mlp_classifier(train: DataFrame, test: DataFrame, group: str = "label", hidden: int = 100, seed: int = 0,
                   v: str = "v", out: str = "pred", max_iter: int = 200) -> DataFrame:
    """Perceptron with one hidden layer."""
    width = train.select(F.size(v)).first()[0]
    return _fit_and_predict(
        lambda classes: MultilayerPerceptronClassifier(
            labelCol="y", layers=[width, hidden, classes], maxIter=max_iter, seed=seed),
        train, test, group, v, out)


def repeated(classifiers: dict, train: DataFrame, test: DataFrame, n: int, group: str = "label") -> DataFrame:
    """Predictions of every classifier, fitted n times with other seeds: (rep, classifier, row_id, label, pred).

    ``classifiers``: name -> function (train, test, seed) that adds ``pred``.
    """
    runs = [
        fn(train, test, rep).select(F.lit(rep).cast("bigint").alias("rep"), F.lit(name).alias("classifier"),
                                    "row_id", group, "pred")
        for name, fn in classifiers.items() for rep in range(n)
    ]
    return reduce(DataFrame.union, runs)
