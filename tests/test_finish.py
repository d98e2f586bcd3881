"""Which nodes leave the levels: by rows of the data, not by draws of them or by copies."""

import numpy as np

from copse.operators import grow as growth
from copse.operators.forest import DecisionTree, RandomForestClassifier


def frame(spark, copies, n=40):
    r = np.random.default_rng(8)
    rows = [(float(a), float(b), int(y)) for a, b, y in zip(r.integers(0, 30, n), r.random(n), r.integers(0, 2, n), strict=True)]
    return spark.createDataFrame([(k * n + i, *x) for k in range(copies) for i, x in enumerate(rows)], "id long, a double, b double, y int")


def nodes(m):
    return sorted((n.node_id, n.feature, n.threshold, n.samples, tuple(n.sums), round(n.gain or 0, 9)) for n in m.trees.nodes.values())


def test_copies_of_rows_ask_for_no_levels(spark, monkeypatch):
    """Sixty copies of 40 rows are 40 rows with counts; before, 2,400 rows went through all levels and ended in an error at depth 61 where splits took few rows each."""
    d = frame(spark, 60)
    want = nodes(DecisionTree(finish_rows=0, max_depth=12).fit(d, ["a", "b"], "y", "id"))

    def refused(*args):
        raise AssertionError("a level")

    monkeypatch.setattr(growth.Growth, "level", refused)
    assert nodes(DecisionTree(finish_rows=40, max_depth=12).fit(d, ["a", "b"], "y", "id")) == want


def test_nodes_are_finished_by_rows_not_draws(spark):
    d = frame(spark, 5)
    m = RandomForestClassifier(n_estimators=3, finish_rows=60, max_depth=8, random_state=2).fit(d, ["a", "b"], "y", "id")
    whole = RandomForestClassifier(n_estimators=3, finish_rows=0, max_depth=8, random_state=2).fit(d, ["a", "b"], "y", "id")
    key = lambda m: sorted((n.tree_id, n.node_id, n.feature, n.samples) for n in m.trees.nodes.values())
    assert key(m) == key(whole)
    levels = [n for n in m.trees.nodes.values() if np.isfinite(n.rows) and not n.is_leaf and n.depth < 4]  # four levels above the limit nothing is left to a task
    assert levels and all(n.rows > 60 for n in levels)
    assert any(n.rows <= 100 < n.samples for n in levels)
