"""Getters, guards, bundles and clashing column names of the models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import proximity, validate, woe
from copse.operators.boost import BoostClassifier, BoostRegressor, LegacyBoost
from copse.operators.forest import DecisionTree, RandomForestClassifier
from copse.operators.proximity import UnsupervisedForest


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a + b > 1), "keep", 7.0, 1.5) for i, (a, b) in enumerate(r.random((120, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, prediction string, x double, raw double").cache()


def test_clashing_names_stay(frame):
    """A user's x and raw columns stay; prediction and probability are the model's."""
    forest = RandomForestClassifier(n_estimators=3, max_depth=2).fit(frame, ["a", "b"], "y", "id")
    boost = BoostClassifier(n_estimators=1, rf_n_estimators=2, rf_max_depth=2).fit(frame, ["a", "b"], "y", "id")
    for m in (forest, boost):
        out = m.transform(frame)
        assert {"x", "raw", "probability", "prediction"} <= set(out.columns)
        assert {tuple(r) for r in out.select("x", "raw").distinct().collect()} == {(7.0, 1.5)}
        assert out.schema["prediction"].dataType.simpleString() == "int"


def test_getters(frame):
    m = RandomForestClassifier(n_estimators=3, max_depth=2).fit(frame, ["a", "b"], "y", "id")
    assert m.get_info() == {"n_estimators": 3, "n_classes": 2, "classes_": [0, 1], "is_fitted": True, "trees_used": 3}
    b = LegacyBoost("regression", n_estimators=1, rf_n_estimators=2, rf_max_depth=1).fit(frame, ["a"], "b", "id")
    assert b.is_fitted and b.trees_used == [2] and b.n_outputs == 1
    assert isinstance(LegacyBoost().estimator, BoostClassifier) and isinstance(LegacyBoost("regression").estimator, BoostRegressor)


def test_unsupervised_getters_and_transform(frame):
    u = UnsupervisedForest(n_estimators=4, max_depth=3, n_neighbors=3)
    m = u.fit(frame, ["a", "b"], "id")
    assert (m.n_estimators_, m.is_fitted_, m.n_samples_, m.n_features_) == (4, True, 120, 2)
    near = m.proximity_sparse().groupBy("i").count().agg(F.max("count")).first()[0]
    assert near == 3
    out = u.fit_transform(frame, ["a", "b"], "id")
    assert out.columns == ["row_id", "c0", "c1"] and out.count() == 120


def test_bag_masks_of_many_trees(spark):
    """More trees than bits in a word."""
    r = np.random.default_rng(5)
    n, trees = 12, 130
    leaf = r.integers(0, 3, (n, trees))
    bag = r.random((n, trees)) < 0.6
    leaves = spark.createDataFrame([(i, t, int(leaf[i, t])) for i in range(n) for t in range(trees)], "row_id long, tree_id int, leaf long")
    drawn = spark.createDataFrame([(i, t) for i in range(n) for t in range(trees) if bag[i, t]], "row_id long, tree_id int")
    got = {(x["i"], x["j"]): x["prox"] for x in proximity.proximity(leaves, drawn).collect()}
    for i in range(n):
        for j in range(n):
            valid = ~(bag[i] & bag[j])
            want = 1.0 if i == j else ((leaf[i] == leaf[j]) & valid).sum() / valid.sum()
            assert np.isclose(got.get((i, j), 0.0), want)


def test_monotone_vector():
    assert validate.monotone({"a": 3, "b": -0.5}, ["a", "b", "c"]) == [1, -1, 0]
    with pytest.raises((KeyError, ValueError)):
        validate.monotone({"z": 1}, ["a"])


def test_zero_weights_say_nothing(frame):
    """Rows of weight zero don't move a tree's leaves."""
    d = frame.withColumn("w", F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0)).withColumn("noisy", F.when(F.col("id") % 3 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    a = DecisionTree(max_depth=2).fit(d, ["a", "b"], "noisy", "id", "w")
    b = DecisionTree(max_depth=2).fit(d.filter("w > 0"), ["a", "b"], "y", "id")
    p, q = (m.transform(d.filter("w > 0").select("id", "a", "b")).orderBy("id").collect() for m in (a, b))
    assert [r["prediction"] for r in p] == [r["prediction"] for r in q]


def test_encoder_bundle_and_task(spark):
    rows = [(i, "abc"[i % 3], "xy"[i % 2], float(i), i % 3, i % 2, i / 7) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, c string, d string, v double, k int, y int, t double")
    assert [woe.task_of(d, c) for c in ("y", "k", "t")] == ["binary", "multiclass", "continuous"]
    cols = ["c", "v", "d"]
    one = woe.WoeEncoder(["c", "d"]).fit(d, cols, "y").to_dict(3, {"c": 0, "v": 1, "d": 2})
    assert one["cat_features"] == [0, 2] and one["numeric_features"] == [1] and not one["woe_multiclass"] and "n_woe_classes" not in one
    assert set(one["woe_tables"][0]) == set("abc") and set(one["woe_tables"][1]) == set("xy")
    many = woe.WoeEncoder(["c", "d"]).fit(d, cols, "k").to_dict(3, {"c": 0, "v": 1, "d": 2})
    assert many["woe_multiclass"] and many["n_woe_classes"] == 3 and [len(t) for t in many["woe_tables"]] == [3, 3]
    pos = {c: sum(r[1] == c and r[5] == 1 for r in rows) for c in "abc"}
    share = {c: (pos[c] + 0.5) / (30 + 1.5) / ((20 - pos[c] + 0.5) / (30 + 1.5)) for c in "abc"}
    assert all(np.isclose(one["woe_tables"][0][c], np.log(share[c])) for c in "abc")
    out = woe.WoeEncoder(["c"]).fit(d, ["c"], "k").transform(d.withColumnsRenamed({"d": "cat", "v": "woe"}), ["id", "cat", "woe"])
    assert out.columns == ["id", "cat", "woe", "woe_c_0", "woe_c_1", "woe_c_2"] and out.count() == 60
    median = woe.WoeEncoder(["c"]).fit(d, ["c"], "t").tables[0]
    assert sum(r["pos"] for r in median.collect()) == 30


def test_checks_in_one_pass_give_the_errors_of_the_checks_on_their_own(spark):
    good = [(i, float(i), 1.0, i % 3, 2.0) for i in range(9)]
    nan, inf = float("nan"), float("inf")

    def frame(*rows):
        return spark.createDataFrame([*good, *rows], "id long, a double, b double, y double, w double")

    good[:] = [(i, a, b, float(y), w) for i, a, b, y, w in good]
    assert validate.check_fit(frame(), "id", ["a", "b"], "y", "w", labels=True) == 3
    assert validate.check_fit(frame(), "id", ["a", "b"], "y") is None
    cases = [((20, nan, inf, 1.0, 1.0), (12, 1.0, None, nan, -1.0)), ((11, 1.0, 1.0, nan, -1.0), (10, 1.0, 1.0, None, 1.0)), ((11, 1.0, 1.0, 1.0, -1.0),), ((11, 1.0, 1.0, 1.0, None),), ((11, 1.0, 1.0, 5.0, 1.0),), ((11, 1.0, 1.0, -1.0, 1.0),)]
    for rows in cases:
        df = frame(*rows)

        def alone(df=df):
            validate.check_finite(df, "id", ["a", "b"], "y")
            validate.check_weights(df, "w")
            return validate.check_labels(df, "y")

        with pytest.raises(ValueError) as want:
            alone()
        with pytest.raises(ValueError) as got:
            validate.check_fit(df, "id", ["a", "b"], "y", "w", labels=True)
        assert str(got.value) == str(want.value)
    none = frame().limit(0)
    with pytest.raises(ValueError, match="0..K-1"):
        validate.check_fit(none, "id", ["a"], "y", labels=True)
    assert validate.check_fit(none, "id", ["a"], "y") is None
