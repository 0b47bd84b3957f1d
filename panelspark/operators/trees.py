"""Tree models per fold on Spark ML, and the model registry."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import LINEAR_MODELS, train_end

c = F.col


def random_forest(seed: int = 42, trees: int = 300, depth: int = 6, leaf: int = 50) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="_x", labelCol="target", predictionCol="score", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed,
        featureSubsetStrategy="all")  # fixed value: a split may use any feature


def boosted_trees(seed: int = 42, rounds: int = 400, depth: int = 4, step: float = 0.03, sample: float = 0.8, features: str = "0.8",
                  leaf: int = 20) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_x", labelCol="target", predictionCol="score", maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=sample, featureSubsetStrategy=features, minInstancesPerNode=leaf, seed=seed)


#: fixed values: model name -> factory, each booster with its own rounds, depth, step, samples and leaf size
TREE_MODELS: Mapping[str, Callable] = {
    "rf": random_forest,
    "xgb": boosted_trees,
    "lgbm": partial(boosted_trees, rounds=500, depth=5, step=0.02, leaf=50),
    "catboost": partial(boosted_trees, sample=1.0, features="all", leaf=1),
}


def available_models() -> list[str]:
    return [*LINEAR_MODELS, *TREE_MODELS]


def build_model(name: str, **params):
    """A fresh estimator or solver; an unknown name raises."""
    if name in LINEAR_MODELS:
        return LINEAR_MODELS[name]
    if name in TREE_MODELS:
        return TREE_MODELS[name](**params)
    raise ValueError(f"unknown model {name!r}; options: {available_models()}")


def walk_forward_trees(panel: DataFrame, features: Sequence[str], folds: DataFrame, horizon: int,
                       estimator: Callable, name: str = "rf", parallel: int = 2) -> DataFrame:
    """Out-of-sample scores, one distributed fit per fold; a few folds are in flight at a time so the
    cluster stays busy between the short stages of a tree level."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(panel.dropna(subset=list(features)))

    def one(f):
        train = rows.where((c("pos") < train_end(f, horizon)) & c("target").isNotNull()).select("_x", "target")
        test = rows.where((c("pos") >= f.test_lo) & (c("pos") < f.test_hi))
        model = estimator().fit(train)
        return model.transform(test).select(
            F.lit(name).alias("model"), F.lit(f.fold).alias("fold"), "date", "pos", "ticker", "score", "target")

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, folds.collect()))
    return reduce(DataFrame.unionByName, parts)
