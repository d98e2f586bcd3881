"""Decision trees and random forests: fit(df) -> model, model.transform(df)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import binning, early_stop, score, validate
from copse.operators.grow import TreeConfig, Trees, grow, prepared
from copse.sources.frames import free_name, training_frame


FINISH_ROWS = TreeConfig.finish_rows


@dataclass
class ForestModel:
    trees: Trees
    features: list[str]
    n_estimators: int
    trees_used: int

    @property
    def n_classes_(self) -> int:
        return self.trees.config.n_classes

    @property
    def classes_(self) -> list[int]:
        return list(range(self.n_classes_))

    @property
    def is_fitted(self) -> bool:
        return bool(self.trees.nodes)

    def get_info(self) -> dict:
        return {"n_estimators": self.n_estimators, "n_classes": self.n_classes_, "classes_": self.classes_, "is_fitted": self.is_fitted, "trees_used": self.trees_used}

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and probability for a classifier. Works on streaming frames; other columns stay, whatever their names, but for those two."""
        if not self.is_fitted:
            raise ValueError("the model has not been fitted")
        cls, x = self.trees.config.classification, free_name(df, "x")
        own = df.drop("prediction", "probability").withColumn(x, F.array(*[F.col(c).cast("double") for c in self.features]))
        out = score.ensemble(own, self.trees, "probability" if cls else "prediction", x).drop(x)
        return out.withColumn("prediction", score.argmax_class(F.col("probability"))) if cls else out

    def score(self, df: DataFrame, target: str) -> float:
        """Accuracy."""
        return float(self.transform(df).agg(F.avg((F.col("prediction") == F.col(target).cast("int")).cast("double"))).first()[0])

    def table(self, spark) -> DataFrame:
        return self.trees.table(spark)

    def get_depth(self) -> int:
        return self.trees.depth()

    def get_n_leaves(self) -> int:
        return self.trees.n_leaves()

    def feature_importances(self) -> list[float]:
        return importances(self.trees)


def importances(trees: Trees) -> list[float]:
    """Shares of samples over internal nodes; features beyond the first tree's largest are left out."""
    widest = trees.widest_feature(trees.tree_ids[0])
    width = (widest or 0) + 1
    total = [0.0] * width
    for f, n in trees.samples_by_feature().items():
        if f < width:
            total[f] += n
    s = sum(total)
    return [t / s if s else 0.0 for t in total]


@dataclass
class _Forest:
    n_estimators: int = 100
    max_depth: int | None = None
    max_features: str | float | None = None
    bootstrap: bool | str = True
    random_state: int = 0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    async_mode: bool = False
    tol: float = 0.0
    finish_rows: int = FINISH_ROWS
    classification = True

    def fit(self, df: DataFrame, features: list[str], target: str, row_id: str, weight: str | None = None) -> ForestModel:
        frame = training_frame(df, row_id, features, target, weight)
        k = validate.check_fit(df, row_id, features, target, weight, self.classification) or 2
        boot = "rows" if self.bootstrap is True else self.bootstrap
        config = TreeConfig(self.classification, k, self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf, validate.max_features(self.max_features, len(features)), bootstrap=boot, seed=self.random_state, finish_rows=self.finish_rows)
        edges = binning.edge_lists(binning.bin_edges(frame))
        data = prepared(frame, config, edges)
        if not self.async_mode:
            trees = grow(data, config, edges, len(features))
            return ForestModel(trees, features, self.n_estimators, self.n_estimators)
        trees, used = early_stop.grow_until_stable(data, config, edges, len(features), self.tol)
        return ForestModel(trees, features, self.n_estimators, used)


class RandomForestClassifier(_Forest):
    classification = True


@dataclass
class RandomForestRegressor(_Forest):
    n_estimators: int = 50
    classification = False


@dataclass
class DecisionTree:
    """One tree, exact splits, all features, no bootstrap. criterion is accepted and not used: Gini or variance."""

    max_depth: int | None = None
    criterion: str = "entropy"
    task: str = "classification"
    random_state: int = 0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    splitter: str = "exact"
    finish_rows: int = FINISH_ROWS

    def fit(self, df: DataFrame, features: list[str], target: str, row_id: str, weight: str | None = None) -> ForestModel:
        if self.task not in ("classification", "regression"):
            raise ValueError("task must be classification or regression")
        frame = training_frame(df, row_id, features, target, weight)
        cls = self.task == "classification"
        config = TreeConfig(cls, validate.check_fit(df, row_id, features, target, weight, cls) or 2, 1, self.max_depth, self.min_samples_split, self.min_samples_leaf, exact=self.splitter == "exact", seed=self.random_state, finish_rows=self.finish_rows)
        edges = None if config.exact else binning.edge_lists(binning.bin_edges(frame))
        return ForestModel(grow(prepared(frame, config, edges), config, edges, len(features)), features, 1, 1)
