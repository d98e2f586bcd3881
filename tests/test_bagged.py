"""Proximities with the bag: by classes and by sets of bags, against NumPy on all pairs of rows."""

import numpy as np
import pytest

from copse.operators import proximity
from copse.operators.proximity import UnsupervisedForest
from copse.plans import registry


def tables(spark, leaf, bag, ids):
    n, trees = leaf.shape
    leaves = spark.createDataFrame([(ids[i], t, int(leaf[i, t])) for i in range(n) for t in range(trees)], "row_id long, tree_id int, leaf long")
    drawn = spark.createDataFrame([(ids[i], t) for i in range(n) for t in range(trees) if bag[i, t]], "row_id long, tree_id int")
    return leaves, drawn


def matrix(leaf, bag):
    out = ~(bag[:, None] & bag[None])
    same, valid = ((leaf[:, None] == leaf[None]) & out).sum(2), out.sum(2)
    return np.where(same > 0, same / np.maximum(valid, 1), 0.0)


@pytest.mark.parametrize("n,trees,kinds,bags", [(90, 4, 5, 3), (40, 70, 3, 40), (60, 2, 2, 60)])
def test_squares_and_pairs_equal_numpy(spark, n, trees, kinds, bags):
    """Few sets of bags (counts by set), as many as rows and more trees than bits (pairs of classes), and rows in every bag."""
    r = np.random.default_rng(n)
    leaf, drawn = r.integers(0, kinds, (n, trees)), r.random((bags, trees)) < 0.6
    bag = drawn[r.integers(0, bags, n)]
    bag[:2] = True
    leaf[5:9], bag[5:9] = leaf[5], bag[5]
    ids = [7 * i + 3 for i in range(n)]
    want = matrix(leaf, bag)
    leaves, own = tables(spark, leaf, bag, ids)
    got = dict(proximity.bagged_squares(leaves, own, trees).collect())
    assert np.allclose([got[i] for i in ids], (want**2).sum(1), rtol=1e-12, atol=0)
    pairs = {(x["i"], x["j"]): x["prox"] for x in proximity.proximity(leaves, own).collect()}
    assert len(pairs) == (want > 0).sum()
    assert all(pairs[ids[i], ids[j]] == want[i, j] for i, j in zip(*np.nonzero(want), strict=True))


@pytest.mark.parametrize("classes", [0, 1000])
def test_expanded_pairs(spark, classes, monkeypatch):
    """Sent to all tasks or joined by shuffles."""
    monkeypatch.setattr(proximity, "SENT_CLASSES", classes)
    members = spark.createDataFrame([(1, 1), (4, 1), (9, 1), (2, 2), (3, 3), (5, 3)], "row_id long, i long")
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (3, 3, 1.0)], "i long, j long, prox double")
    got = sorted(tuple(x) for x in proximity.expanded(pairs, members).collect())
    want = [(a, b, 1.0) for a in (1, 4, 9) for b in (1, 4, 9)] + [(a, 2, 0.5) for a in (1, 4, 9)] + [(2, a, 0.5) for a in (1, 4, 9)] + [(a, b, 1.0) for a in (3, 5) for b in (3, 5)]
    assert got == sorted(want)


def test_no_pair_of_rows_is_shuffled(spark, sf_dir):
    plan = registry.QUERIES["proximity_oob"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_scores_with_few_bags_make_no_pairs_of_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.random((300, 2)))], "id long, a double, b double")
    m = UnsupervisedForest(n_estimators=2, max_depth=2, random_state=1).fit(df, ["a", "b"], "id")
    want = dict(proximity.outlier_scores(proximity.pair_squares(m.proximity_matrix(), m.train), 300).collect())

    def refused(*args):
        raise ValueError("pairs")

    monkeypatch.setattr(proximity, "check_pairs", refused)
    got = dict(m.outlier_scores().collect())
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
