"""Classifiers by name, clustering and reduction, with Spark ML where it has them."""

from __future__ import annotations

import json
from dataclasses import asdict
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import LDA, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, HashingTF, SQLTransformer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from foreglass.operators import many_fits as M
from foreglass.scale import cut_lineage

FEATURES, LABEL = "features", "label"
AT_ONCE = 4


def with_vector(df: DataFrame, array: str, name: str = FEATURES) -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def _least_squares(l1_share: float, strength: float) -> list:
    """Least squares on labels -1 / +1; the sign of the fit is the class."""
    return [
        SQLTransformer(statement=f"SELECT *, 2.0 * {LABEL} - 1.0 AS _signed FROM __THIS__"),
        LinearRegression(
            featuresCol=FEATURES, labelCol="_signed", predictionCol="_fit", elasticNetParam=l1_share, regParam=strength
        ),
        SQLTransformer(statement="SELECT *, CASE WHEN _fit > 0 THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__"),
    ]


class FittedRule(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Weights or trees of ``many_fits`` as a saveable model that adds ``prediction``."""

    name = Param(Params._dummy(), "name", "registered name", TypeConverters.toString)
    fitted = Param(Params._dummy(), "fitted", "weights, or lists of trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, name: str = "", fitted: str = "[]") -> None:
        super().__init__()
        self._set(name=name, fitted=fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, found = self.getOrDefault(self.name), json.loads(self.getOrDefault(self.fitted))
        array = vector_to_array(FEATURES)
        if name in M.STRENGTHS:
            weights = F.array(*[F.lit(float(w)) for w in found[:-1]])
            margin = F.aggregate(F.zip_with(array, weights, lambda x, w: x * w), F.lit(float(found[-1])), lambda a, x: a + x)
            return dataset.withColumn("prediction", (margin > 0).cast("double"))
        trees = [[M.Tree(**t) for t in grown] for grown in found]

        @F.pandas_udf("double")
        def answer(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            return pd.Series(M.class_of(name, trees, np.stack(rows.to_numpy())).astype(float))

        return dataset.withColumn("prediction", answer(array))


class SharedPasses(Estimator):
    """A model of ``many_fits`` by name: mistake-driven training, or trees by slopes and curvatures."""

    @keyword_only
    def __init__(self, name: str, seed: int, trees: int = 100) -> None:
        super().__init__()
        self.name, self.seed, self.trees = name, seed, trees

    def _fit(self, dataset: DataFrame) -> FittedRule:
        x = vector_to_array(FEATURES)
        rows = M.part_rows(dataset.select(x.alias("x"), F.col(LABEL).alias("y"), F.array(F.lit(1)).alias("part"), F.xxhash64(x).alias("row")))
        found = M.fit_grid(rows, [self.name], [self.seed], self.trees)[self.name, 0]
        plain = found.tolist() if isinstance(found, np.ndarray) else [[asdict(t) for t in grown] for grown in found]
        return FittedRule(name=self.name, fitted=json.dumps(plain))


def _makers(seed: int, rows: int, trees: int = 100) -> dict:
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    # Spark averages the loss over the rows, so a unit penalty on the summed loss is 1 / rows
    unit = 1.0 / max(rows, 1)
    return {
        # without a Spark ML twin: trained by tasks on their own rows, weights mixed after each round
        "perceptron": lambda: [SharedPasses(name="perceptron", seed=seed)],
        "sgd": lambda: [SharedPasses(name="sgd", seed=seed)],
        "logistic": lambda: [LogisticRegression(**common, maxIter=1000, tol=1e-4, regParam=unit)],
        "ridge": lambda: _least_squares(0.0, unit),
        "linear": lambda: _least_squares(0.0, 0.0),
        "elastic_net": lambda: _least_squares(0.5, 0.01),
        "decision_tree": lambda: [DecisionTreeClassifier(**common, seed=seed)],
        "random_forest": lambda: [RandomForestClassifier(**common, seed=seed, numTrees=100)],
        "gradient_boosting": lambda: [GBTClassifier(**common, seed=seed, maxIter=trees, maxDepth=3)],
        "svm": lambda: [LinearSVC(**common, maxIter=1000, tol=1e-3, regParam=unit)],
        "xgboost": lambda: [SharedPasses(name="xgboost", seed=seed, trees=trees)],  # second-order boosting
    }


MODEL_NAMES = list(_makers(0, 1))


def make_model(name: str, seed: int = 42, rows: int = 1000) -> Pipeline:
    """An unfitted model; ``rows`` is the size of the training set."""
    makers = _makers(seed, rows)
    if name not in makers:
        raise ValueError(f"unknown model {name}")
    return Pipeline(stages=makers[name]())


def train_models(train: DataFrame, names: list[str], seed: int = 42, save_to: str | None = None) -> dict:
    """Fit each model on the same rows; saved below ``save_to/<name>`` if given."""
    kept = train.select(FEATURES, F.col(LABEL).cast("double").alias(LABEL)).persist()
    try:
        rows = kept.count()
        # fits are many short jobs; side by side they fill the waits of each other
        with ThreadPool(min(AT_ONCE, len(names))) as pool:
            fitted = dict(zip(names, pool.map(lambda name: make_model(name, seed, rows).fit(kept), names)))
        if save_to:
            for name in names:
                fitted[name].write().overwrite().save(f"{save_to}/{name}")
    finally:
        kept.unpersist()
    return fitted


def load_models(folder: str, names: list[str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{folder}/{name}") for name in names}


def predict(df: DataFrame, models: dict, suffix: str = " Prediction") -> DataFrame:
    """One integer output column per model; the rows stay where they are, no joins."""
    result = df.withColumn(LABEL, F.col(LABEL).cast("double")) if LABEL in df.columns else df
    keep = list(result.columns)
    if LABEL not in keep:
        result = result.withColumn(LABEL, F.lit(None).cast("double"))
    for name, model in models.items():
        scored = model.transform(result)
        column = f"{name}{suffix}"
        keep.append(column)
        result = scored.withColumn(column, F.col("prediction").cast("int")).select(
            *[c for c in dict.fromkeys([*keep, LABEL])]
        )
    result = result.select(*keep)
    return result.withColumn(LABEL, F.col(LABEL).cast("int")) if LABEL in keep else result


def fold_scores(df: DataFrame, name: str, k: int, seed: int = 42) -> DataFrame:
    """Accuracy of a model per fold (``df`` has ``fold``), then mean and sample std."""
    kept = cut_lineage(df)  # every fold reads the same rows, also when the result runs later
    scored = None
    for fold in range(k):
        fitted = train_models(kept.filter(F.col("fold") != fold), [name], seed)
        part = predict(kept.filter(F.col("fold") == fold), fitted, "").select(
            "fold", (F.col(LABEL) == F.col(name)).cast("double").alias("hit")
        )
        scored = part if scored is None else scored.unionByName(part)
    per_fold = scored.groupBy("fold").agg(F.avg("hit").alias("accuracy"))
    return per_fold.agg(
        F.count("*").alias("folds"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_samp("accuracy").alias("accuracy_std"),
    )


def scale_vectors(df: DataFrame, name: str = "scaled") -> DataFrame:
    scaler = StandardScaler(inputCol=FEATURES, outputCol=name, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)


def kmeans_groups(df: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list]:
    """Rows with their cluster, and the centres."""
    model = KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster").fit(df)
    return model.transform(df), [list(map(float, c)) for c in model.clusterCenters()]


def mixture_groups(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    model = GaussianMixture(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster").fit(df)
    return model.transform(df)


def principal_components(df: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred vectors projected on ``k`` components, and the explained variance shares."""
    centred = StandardScaler(inputCol=FEATURES, outputCol="_centred", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="components").fit(centred)
    return model.transform(centred).drop("_centred"), list(map(float, model.explainedVariance))


def topics(df: DataFrame, tokens: str, k: int = 2, vocabulary: int = 1 << 18, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Topic shares per text over all its words; a text without words has zeros.

    Words are counted by hash, so ``vocabulary`` bounds the model that tasks share and no word
    is left out, however many there are: a text of rare words only has shares too.
    """
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=vocabulary).transform(df.withColumn("_words", words))
    model = LDA(k=k, seed=seed, maxIter=rounds, featuresCol="_counts", topicDistributionCol="_topics").fit(counts)
    return model.transform(counts).withColumn("topics", vector_to_array("_topics")).drop("_words", "_counts", "_topics")


def vector_item(column: str, index: int) -> Column:
    return F.get(vector_to_array(column), F.lit(index))
