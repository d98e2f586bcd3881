"""Outlier scores and scaling without pairs, against whole matrices in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import leafwise, proximity
from copse.operators.proximity import UnsupervisedForest


def drawn(n, trees, leaves, seed):
    r = np.random.default_rng(seed)
    hidden = r.normal(size=(n, 3))
    cut = hidden @ r.normal(size=(3, trees)) + 0.4 * r.normal(size=(n, trees))
    return np.floor((cut - cut.min()) * leaves / (np.ptp(cut) + 1e-9)).astype(int)


def table(spark, leaf, first=0):
    return spark.createDataFrame([(first + i, t, int(x)) for i, row in enumerate(leaf) for t, x in enumerate(row)], "row_id long, tree_id int, leaf long")


def matrix(a, b):
    return (a[:, None] == b[None]).mean(2)


def scaled(a, k):
    b = 0.5 * (a - a.mean(0) - a.mean(1)[:, None] + a.mean())
    lam, u = np.linalg.eigh(b)
    alternating = np.where(np.arange(len(a)) % 2 == 0, 1.0, -1.0)
    u = u[:, ::-1][:, :k]
    return u * np.sqrt(lam[::-1][:k]) * np.where(u.T @ alternating < 0, -1.0, 1.0)


@pytest.mark.parametrize("shape", [(60, 1, 3), (90, 7, 4), (40, 12, 30)])
def test_squares_equal_the_matrix(spark, shape):
    leaf = drawn(*shape, seed=3)
    leaf[: len(leaf) // 3] = leaf[0]  # a third of the rows alike
    got = dict(leafwise.squares(table(spark, leaf)).collect())
    assert np.allclose([got[i] for i in range(len(leaf))], (matrix(leaf, leaf) ** 2).sum(1))


def test_squares_of_new_rows(spark):
    leaf, new = drawn(70, 6, 5, 1), drawn(20, 6, 5, 2)
    new[4] = 99  # shares no leaf
    d = dict(leafwise.squares(table(spark, new, 1000), table(spark, leaf)).collect())
    assert sorted(d) == list(range(1000, 1020)) and d[1004] == 0
    assert np.allclose([d[1000 + i] for i in range(20)], (matrix(new, leaf) ** 2).sum(1))
    by_pairs = dict(proximity.squares(table(spark, new, 1000), table(spark, leaf)).collect())
    assert by_pairs == pytest.approx(d)
    scores = dict(proximity.outlier_new(leafwise.squares(table(spark, new, 1000), table(spark, leaf)), 70).collect())
    assert scores[1004] == 20


def test_both_ways_are_counted(spark):
    leaf = drawn(50, 5, 3, 4)
    pairs, entries = leafwise.costs(table(spark, leaf))
    assert pairs == (leaf[:, None] == leaf[None]).sum() and entries == 50 * 15
    few = np.arange(50)[:, None] * np.ones(5, int)  # every row alone in its leaves
    assert leafwise.costs(table(spark, few)) == (250, 750)
    assert set(r["s"] for r in proximity.squares(table(spark, few)).collect()) == {1.0}


@pytest.mark.parametrize("on_driver", [0, 1000])
def test_scaling_equals_numpy(spark, on_driver):
    leaf = drawn(80, 9, 4, 6)
    leaf[50:70] = leaf[3]
    got = leafwise.scaling(table(spark, leaf), 2, on_driver=on_driver).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(80))
    assert np.allclose([(r["c0"], r["c1"]) for r in got], scaled(matrix(leaf, leaf), 2), atol=1e-5)


@pytest.mark.parametrize("on_driver", [0, 1000])
def test_scaling_of_few_classes_has_zero_columns(spark, on_driver):
    leaf = np.array([[0], [0], [1], [0], [1]])
    got = leafwise.scaling(table(spark, leaf), 3, on_driver=on_driver).orderBy("row_id").collect()
    want = scaled(matrix(leaf, leaf), 1)
    assert np.allclose([r["c0"] for r in got], want[:, 0], atol=1e-6)
    assert all(r["c1"] == 0 and r["c2"] == 0 for r in got)


@pytest.mark.parametrize("on_driver", [0, 1000])
def test_empty_and_single_rows(spark, on_driver):
    none = table(spark, np.zeros((0, 2), int))
    assert leafwise.squares(none).count() == 0 and leafwise.scaling(none, 2, on_driver=on_driver).count() == 0
    one = table(spark, np.array([[4, 2]]))
    assert leafwise.squares(one).collect() == [(0, 1.0)]
    assert leafwise.scaling(one, 2, on_driver=on_driver).collect() == [(0, 0.0, 0.0)]


def test_scores_of_a_forest(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(90, 2))
    x[5] = 9.0
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    m = UnsupervisedForest(n_estimators=8, max_depth=4).fit(df, ["a", "b"], "id")
    pairs = proximity.pair_squares(m.proximity_matrix(False), m.train)
    want = dict(proximity.outlier_scores(pairs, 90).collect())
    assert dict(m.outlier_scores(use_oob=False).collect()) == pytest.approx(want)
    oob = m.outlier_scores()
    assert oob.count() == 90 and oob.agg(F.max("score")).first()[0] <= 20
    assert m.transform(2, use_oob=False).count() == 90
    assert m.predict_outlier_scores(df, "id").count() == 90


@pytest.mark.parametrize("shape,k", [((60, 5, 3), 4), ((80, 12, 25), 3), ((30, 1, 2), 40)])
def test_nearest_equals_the_window_over_all_pairs(spark, shape, k):
    leaf = drawn(*shape, seed=9)
    leaf[: len(leaf) // 3] = leaf[0]  # copies, of which each row sees the least ids
    lv = table(spark, leaf)
    found = leafwise.nearest(lv, k)
    got = sorted((r["i"], r["rank"], r["j"], round(r["prox"], 9)) for r in found.collect())
    want = sorted((r["i"], r["rank"], r["j"], round(r["prox"], 9)) for r in proximity.nearest(proximity.proximity(lv), k).collect())
    assert got == want


def test_nearest_stops_before_all_pairs(spark):
    """Groups of rows alike in most trees, and one tree whose leaf holds all rows."""
    leaf = np.repeat(np.arange(40), 5)[:, None] * np.ones(12, int)
    leaf[:, 0] = 0
    leaf[:, 1] = np.arange(200)  # so that all rows are classes of their own
    found = leafwise.nearest(table(spark, leaf), 3)
    a = matrix(leaf, leaf)
    want = {i: [int(j) for j in np.lexsort((np.arange(200), -a[i])) if j != i][:3] for i in range(200)}
    got = {}
    for r in found.orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    assert got == want and found.pairs_examined < 200 * 12  # of 40,000
    with pytest.raises(ValueError, match="pairs of classes"):
        leafwise.nearest(table(spark, leaf), 3, most=10)


def test_nearest_of_few_rows(spark):
    assert leafwise.nearest(table(spark, np.array([[4, 2]])), 2).count() == 0
    assert leafwise.nearest(table(spark, np.array([[1, 1], [2, 2]])), 2).count() == 0
    assert leafwise.nearest(table(spark, np.zeros((0, 2), int)), 2).count() == 0
