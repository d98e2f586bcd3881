"""Gradient boosting whose base learner is a forest: binary, multiclass, regression.

Rows carry their raw scores f (one per output). A round turns them into
targets and weights with column expressions, grows a regression forest, adds
the learning rate times its mean, and writes the rows once (bins and scores, not
the features' values), so the plan stays short however many rounds follow; the
generation before is dropped. Edges and bins depend on the features only and are
made once per fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.functions.scalar import CLAMP, clamp, logit, sigmoid, softmax, wilson, z_of
from copse.operators import binning, early_stop, validate
from copse.operators.grow import TreeConfig, Trees, descend, grow, matrix, with_multiplicity
from copse.operators.score import argmax_class, blocks_of, chunks
from copse.operators.trees import BLOCK_NODES
from copse.sources.frames import dropped, free_name, materialised, training_frame, with_rank


def binary_prior(df: DataFrame, y: str = "y", w: str = "w") -> DataFrame:
    """One row: the logit of the clamped weighted mean of y (one half if the weights sum to nothing)."""
    mean = F.when(F.sum(w) > 0, F.sum(F.col(w) * F.col(y)) / F.sum(w)).otherwise(F.lit(0.5))
    return df.agg(logit(clamp(mean)).alias("init"))


def class_priors(df: DataFrame, y: str = "y", w: str = "w") -> DataFrame:
    """(label, init): the logarithm of each class's clamped weight share."""
    c = df.groupBy(F.col(y).cast("int").alias("label")).agg(F.sum(w).alias("cw"))
    total = df.agg(F.sum(w).alias("total"))
    return c.join(F.broadcast(total)).select("label", F.log(clamp(F.col("cw") / F.col("total"))).alias("init"))  # one row


def regression_init(df: DataFrame, y: str = "y", w: str = "w") -> DataFrame:
    return df.agg(F.when(F.sum(w) > 0, F.sum(F.col(w) * F.col(y)) / F.sum(w)).otherwise(F.lit(0.0)).alias("init"))


def newton_binary(score, y, w):
    """(target, weight) of a binary round."""
    p = clamp(sigmoid(score))
    h = p * (1 - p)
    return (y - p) / h, w * h


def newton_softmax(scores, k: int, y, w):
    """(target, weight) of class k of a multiclass round."""
    p = clamp(softmax(scores)[k])
    h = p * (1 - p)
    return ((y.cast("int") == k).cast("double") - p) / h, w * h


@dataclass
class BoostModel:
    task: str  # binary, multiclass or regression
    features: list[str]
    n_classes: int
    learning_rate: float
    init: list[float]
    rounds: list[list[Trees]] = field(default_factory=list)
    trees_used: list[int] = field(default_factory=list)
    conformal_quantile: float | None = None

    @property
    def n_outputs(self) -> int:
        return len(self.init)

    @property
    def is_fitted(self) -> bool:
        return bool(self.rounds)

    def _sent(self, spark) -> list:
        """Broadcasts of (output, rate a tree, arrays), of BLOCK_NODES nodes each or a block of one round's model."""
        out, held, size = [], [], 0
        for r in self.rounds:
            for o, trees in enumerate(r):
                rate = self.learning_rate / len(trees.tree_ids)
                for make in trees.blocks():
                    held.append((o, rate, make()))
                    size += sum(len(t["feature"]) for t in held[-1][2])
                    if size >= BLOCK_NODES:
                        out.append(spark.sparkContext.broadcast(held))
                        held, size = [], 0
        return [*out, *([spark.sparkContext.broadcast(held)] if held else [])]

    def raw(self, df: DataFrame, column: str = "raw") -> DataFrame:
        """Adds an array<double> of raw scores: init + learning rate x sum of forest means, all rounds folded into one pass."""
        if not self.is_fitted:
            raise ValueError("the model has not been fitted")
        model, init = self._sent(df.sparkSession), np.array(self.init)
        names, x = self.features, free_name(df, "x")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{column}` array<double>"
        columns = [*df.columns, column]

        def run(batches):
            for pdf in chunks(batches, len(model) > 1):
                m = matrix(pdf[x])
                out = np.tile(init, (len(pdf), 1))
                for parts in blocks_of(model) if len(pdf) else ():
                    for o, rate, trees in parts:
                        out[:, o] += rate * sum(t["value"][descend(t, m)] for t in trees)
                yield pdf.assign(**{column: list(out)})[columns]

        return df.withColumn(x, F.array(*[F.col(c).cast("double") for c in names])).mapInPandas(run, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and probability for a classifier; other columns stay, whatever their names, but for those two."""
        df = df.drop("prediction", "probability")
        raw = free_name(df, "raw")
        d, scores = self.raw(df, raw), F.col(raw)
        if self.task == "regression":
            return d.withColumn("prediction", scores[0]).drop(raw)
        if self.task == "binary":
            p = sigmoid(scores[0])
            return d.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (p > 0.5).cast("int")).drop(raw)
        return d.withColumn("probability", softmax(scores)).withColumn("prediction", argmax_class(F.col("probability"))).drop(raw)

    def predict_ci(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Adds ci_low and ci_high: Wilson over all trees (binary) or the conformal half-width (regression)."""
        d = self.transform(df)
        if self.task == "regression":
            q = self.conformal_quantile * (1.0 if alpha == 0.05 else z_of(alpha) / z_of(0.05))
            return d.withColumn("ci_low", F.col("prediction") - q).withColumn("ci_high", F.col("prediction") + q)
        if self.task != "binary":
            raise ValueError("intervals are for binary classification and regression")
        n = sum(len(t.tree_ids) for r in self.rounds for t in r)
        lo, hi = wilson(F.col("probability")[1], float(n), z_of(alpha))
        return d.withColumn("ci_low", lo).withColumn("ci_high", hi)

    def feature_importances(self) -> list[float]:
        from copse.operators.forest import importances

        width = len(importances(self.rounds[0][0]))
        total = np.zeros(width)
        for r in self.rounds:
            for t in r:
                for f, n in t.samples_by_feature().items():
                    if f < width:
                        total[f] += n
        return (total / total.sum()).tolist() if total.sum() else total.tolist()

    def table(self, spark) -> DataFrame:
        from copse import schema

        own = [(r, o, t) for r, outs in enumerate(self.rounds) for o, t in enumerate(outs)]
        out = spark.createDataFrame([x for r, o, t in own if t.rest is None for x in t.rows(round=r, output=o)], schema.MODEL)
        for r, o, t in own:
            out = out if t.rest is None else out.unionByName(t.table(spark, round=r, output=o))
        return out


@dataclass
class _Boost:
    n_estimators: int = 20
    learning_rate: float = 0.1
    rf_n_estimators: int = 20
    rf_max_depth: int | None = None
    rf_max_features: str | float | None = None
    bootstrap: bool | str = True
    random_state: int = 0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    use_histogram: bool = True
    async_mode: bool = False
    tol: float = 1e-4
    finish_rows: int = TreeConfig.finish_rows

    def _config(self, p: int, round_: int, output: int, monotone: list[int]) -> TreeConfig:
        boot = "rows" if self.bootstrap is True else self.bootstrap
        return TreeConfig(False, 2, self.rf_n_estimators, self.rf_max_depth, self.min_samples_split, self.min_samples_leaf, validate.max_features(self.rf_max_features, p), monotone, not self.use_histogram, boot, self.random_state + 1000 * round_ + output, finish_rows=self.finish_rows)

    def _rounds(self, frame: DataFrame, model: BoostModel, monotone: list[int]) -> DataFrame:
        """Adds rounds to model; frame has (row_id, x, y, w); returns it with the final scores f."""
        p = len(model.features)
        edges = binning.edge_lists(binning.bin_edges(frame)) if self.use_histogram else None
        base = frame.withColumn("f", F.array(*[F.lit(v) for v in model.init]))
        if edges is not None:
            base = binning.assign_bins(base, edges).drop("x")
        base = with_rank(base, ["row_id"]) if self._config(p, 0, 0, []).bootstrap in ("exact", "rows") else base
        data = materialised(base, "boost")
        n = data.count() if "rank" in data.columns else 0

        for r in range(self.n_estimators):
            outs: list[Trees] = []
            for o in range(model.n_outputs):
                y, w, f = F.col("y"), F.col("w"), F.col("f")
                if model.task == "binary":
                    target, weight = newton_binary(f[0], y, w)
                elif model.task == "multiclass":
                    target, weight = newton_softmax(f, o, y, w)
                else:
                    target, weight = y - f[0], w
                config = self._config(p, r, o, monotone)
                config.rows = n
                fit = data.withColumn("target", target).withColumn("hw", weight).drop("y", "w", "f").withColumnsRenamed({"target": "y", "hw": "w"})
                fit = with_multiplicity(fit, config)
                if config.bootstrap == "exact":  # a join, made once; other draws are made in the row
                    fit = materialised(fit, "round")
                if self.async_mode:
                    rule = "updates" if model.task != "regression" else "regression"
                    trees, used = early_stop.grow_until_stable(fit, config, edges, p, self.tol, max(self.rf_n_estimators // 2, 3), rule)
                else:
                    trees, used = grow(fit, config, edges, p), self.rf_n_estimators
                outs.append(trees)
                if o == 0:
                    model.trees_used.append(used)
                before, data = data, materialised(self._updated(data, trees, o), "boost")
                dropped(fit)
                dropped(before)
            model.rounds.append(outs)
        return data

    def _updated(self, data: DataFrame, trees: Trees, output: int) -> DataFrame:
        """data with the rate times the trees' mean added to f, by bins where it holds them."""
        one = BoostModel("", [], 0, self.learning_rate, [])
        one.rounds = [[trees]]
        model = one._sent(data.sparkSession)
        features, cut = ("b", "bin") if "b" in data.columns else ("x", "threshold")

        def run(batches):
            for pdf in chunks(batches, len(model) > 1):
                if len(pdf):
                    x, f = matrix(pdf[features]), matrix(pdf["f"])
                    for parts in blocks_of(model):
                        for _, rate, own in parts:
                            f[:, output] += rate * sum(t["value"][descend(t, x, cut)] for t in own)
                    pdf = pdf.assign(f=list(f))
                yield pdf

        return data.mapInPandas(run, data.schema)


@dataclass
class BoostClassifier(_Boost):
    monotone_constraints: dict | None = None

    def fit(self, df: DataFrame, features: list[str], target: str, row_id: str, weight: str | None = None) -> BoostModel:
        frame = training_frame(df, row_id, features, target, weight)
        k = validate.check_fit(df, row_id, features, target, weight, labels=True)
        if k <= 2:
            model = BoostModel("binary", features, 2, self.learning_rate, [binary_prior(frame).first()["init"]])
        else:
            model = BoostModel("multiclass", features, k, self.learning_rate, [r["init"] for r in class_priors(frame).orderBy("label").collect()])
        self._rounds(frame, model, validate.monotone(self.monotone_constraints, features))
        return model


@dataclass
class BoostRegressor(_Boost):
    conformal_fraction: float = 0.2

    def fit(self, df: DataFrame, features: list[str], target: str, row_id: str, weight: str | None = None) -> BoostModel:
        """Fits on a part to calibrate the interval on the rest, then on all rows."""
        from copse.operators.intervals import conformal_quantile, conformal_split

        frame = training_frame(df, row_id, features, target, weight)
        validate.check_fit(df, row_id, features, target, weight)
        share = min(max(self.conformal_fraction, 0.1), 0.5)
        both = materialised(conformal_split(frame, share, self.random_state), "conformal")
        if both.filter("is_calibration").isEmpty():
            raise ValueError("too few rows to calibrate an interval")
        train = both.filter("not is_calibration").select(*frame.columns)
        first = BoostModel("regression", features, 1, self.learning_rate, [regression_init(train).first()["init"]])
        self._rounds(train, first, [])
        cal = both.filter("is_calibration").select("row_id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(features)])
        scored = first.transform(cal).select((F.abs(F.col("y") - F.col("prediction"))).alias("residual"))
        model = BoostModel("regression", features, 1, self.learning_rate, [regression_init(frame).first()["init"]])
        self._rounds(frame, model, [])
        model.conformal_quantile = conformal_quantile(scored).first()["q"]
        return model


class LegacyBoost:
    """Task-switched facade: classification, else regression."""

    def __init__(self, task: str = "classification", **kw):
        self.estimator = BoostClassifier(**kw) if task == "classification" else BoostRegressor(**kw)

    def fit(self, *args, **kw) -> BoostModel:
        return self.estimator.fit(*args, **kw)


__all__ = ["CLAMP", "BoostClassifier", "BoostModel", "BoostRegressor", "LegacyBoost", "binary_prior", "class_priors", "newton_binary", "newton_softmax", "regression_init"]
