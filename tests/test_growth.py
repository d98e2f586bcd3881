"""How trees are grown: routes, siblings, draws in the row, finished parts and models in tables, each against the plain way."""

import glob

import numpy as np
import pytest

from copse.operators import binning, draws, early_stop, grow, score, trees
from copse.operators.boost import BoostClassifier, BoostModel, BoostRegressor, LegacyBoost
from copse.operators.forest import DecisionTree, ForestModel, RandomForestClassifier, RandomForestRegressor
from copse.operators.grow import TreeConfig, prepared, row_draws
from copse.operators.trees import Trees
from copse.sources import export
from copse.sources.frames import dropped, materialised, training_frame, work_dir

NAMES = ["a", "b", "c"]


def table(spark, x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), float(w[i])) for i in range(len(y))], "id long, a double, b double, c double, y double, w double").repartition(3)


@pytest.fixture(scope="module")
def data():
    r = np.random.RandomState(42)
    x = np.round(r.rand(400, 3) * 4, 1)
    return x, (x[:, 0] + x[:, 1] - x[:, 2] + r.randn(400) > 1.5).astype(float), np.floor(4 * x[:, 0] + 3 * r.randn(400))


@pytest.fixture(scope="module")
def frames(spark, data):
    x, label, value = data
    return {True: materialised(training_frame(table(spark, x, label), "id", NAMES, "y"), "t"), False: materialised(training_frame(table(spark, x, value), "id", NAMES, "y"), "t")}


def grown(frame, **kw):
    c = TreeConfig(**{"n_trees": 3, "bootstrap": "rows", "seed": 5} | kw)
    edges = None if c.exact else binning.edge_lists(binning.bin_edges(frame))
    return grow.grow(prepared(frame, c, edges), c, edges, 3)


def nodes(t: Trees):
    return {k: (n.depth, n.samples, n.feature, n.threshold, round(n.weight, 9), tuple(round(s, 6) for s in n.sums), n.lower, n.upper) for k, n in t.nodes.items()}


@pytest.mark.parametrize("cls,kw", [(True, {}), (False, {"min_samples_leaf": 5})], ids=str)
def test_siblings_and_routes_give_the_same_trees(frames, monkeypatch, cls, kw):
    kw = {"classification": cls, "max_depth": 5, "finish_rows": 0, "n_trees": 2} | kw
    want = nodes(grown(frames[cls], subtract=False, **kw))
    monkeypatch.setattr(grow, "ROUTE_LEVELS", 1 if cls else 100)
    assert nodes(grown(frames[cls], subtract=True, **kw)) == want
    if cls:
        monkeypatch.setattr(grow, "HIST_CELLS", 1)  # a tree at a time
        assert nodes(grown(frames[cls], subtract=True, **kw)) == want


def test_half_the_histogram_rows(frames, monkeypatch):
    """Below the root, tasks return the histograms of the smaller children only."""
    seen = []
    plain = grow.Growth.histogram
    monkeypatch.setattr(grow.Growth, "histogram", lambda self, asked, depth: seen.append((depth, {t: set(v.tolist()) for t, v in asked.items()})) or plain(self, asked, depth))
    t = grown(frames[True], classification=True, max_depth=4, finish_rows=0, bootstrap=False, n_trees=1)
    for depth, asked in seen[1:]:
        for i in asked[0]:
            sibling = i + 1 if i % 2 else i - 1
            assert sibling not in asked[0] and depth > 0
            assert t.nodes[0, i].samples <= t.nodes[0, sibling].samples or t.nodes[0, sibling].samples < 2


@pytest.mark.parametrize("cls,exact,kw", [(True, False, {"max_depth": 7}), (False, True, {"max_depth": 7, "min_samples_leaf": 3, "min_samples_split": 9}), (True, False, {"max_depth": None, "max_features": 1})], ids=str)
def test_finished_parts_equal_levels(frames, cls, exact, kw):
    kw = {"classification": cls, "exact": exact, "n_trees": 2} | kw
    want = nodes(grown(frames[cls], finish_rows=0, **kw))
    assert nodes(grown(frames[cls], finish_rows=60, finish_levels=1, **kw)) == want


def test_finished_parts_keep_limits(spark):
    r = np.random.RandomState(0)
    x, w = np.round(r.randn(500, 3), 1), r.choice([0.5, 1.0, 2.0], 500)
    d = training_frame(table(spark, x, np.floor(4 * x[:, 0] ** 2 - 2 * x[:, 1]), w), "id", NAMES, "y", "w")
    kw = {"classification": False, "monotone": [1, -1, 0], "max_depth": 5, "bootstrap": False, "n_trees": 1}
    want, got = nodes(grown(d, finish_rows=0, **kw)), nodes(grown(d, finish_rows=200, finish_levels=1, **kw))
    assert got.keys() == want.keys()
    assert all(np.allclose([v if v is not None else 0 for v in (*got[k][:5], *got[k][6:])], [v if v is not None else 0 for v in (*want[k][:5], *want[k][6:])]) for k in want)


def test_chains_of_any_depth(spark):
    """A tree of 119 levels: beyond the heap ids that a long holds."""
    y = [2.0**i for i in range(120)]
    d = table(spark, np.stack([np.arange(120), np.zeros(120), np.zeros(120)], axis=1), y)
    m = DecisionTree(max_depth=None, task="regression").fit(d, NAMES, "y", "id")
    assert m.get_depth() > 61 and m.get_n_leaves() > 61
    got = {r["id"]: r["prediction"] for r in m.transform(d).collect()}
    leaves = {k: n for k, n in m.trees.nodes.items() if n.is_leaf}
    assert sum(n.samples for n in leaves.values()) == 120
    assert all(got[i] == pytest.approx(y[i]) for i in range(70, 120))
    t = {r["node_id"]: r for r in m.table(spark).collect()}
    assert all(t[r[side]]["depth"] == r["depth"] + 1 for r in t.values() if not r["is_leaf"] for side in ("left_id", "right_id"))
    assert len({r["left_id"] for r in t.values() if not r["is_leaf"]} | {r["right_id"] for r in t.values() if not r["is_leaf"]}) == len(t) - 1


def test_unlimited_depth_fits_every_row(spark, data):
    x, y, _ = data
    first = {}
    for i, v in enumerate(map(tuple, x)):
        first.setdefault(v, i)
    own = sorted(first.values())
    d = table(spark, x[own], y[own])
    m = DecisionTree().fit(d, NAMES, "y", "id")
    assert m.score(d, "y") == 1.0


def test_features_tried_are_those_of_the_driver(spark):
    c = TreeConfig(max_features=3, seed=11)
    nodes = spark.createDataFrame([(t, i) for t in range(3) for i in (0, 1, 6, 2**40)], "tree_id int, node_id long")
    got = nodes.select("tree_id", "node_id", trees.features_tried(c, 7, nodes.tree_id, nodes.node_id).alias("f")).collect()
    assert all(sorted(r["f"]) == trees.feature_subset(c, 7, r["tree_id"], r["node_id"]) for r in got)


# --- draws -----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 4096, 4097, 50_000])
def test_counts_sum_to_n(n):
    rank = np.arange(n)
    for t in range(3):
        m = draws.counts(9, t, n, rank)
        assert m.sum() == n and (m >= 0).all()
        shuffled = np.random.RandomState(t).permutation(n)
        assert (draws.counts(9, t, n, shuffled) == m[shuffled]).all()
        for part in np.array_split(rank, 7):
            assert (draws.counts(9, t, n, part) == m[part]).all()
    if n > 1000:
        assert not (draws.counts(9, 0, n, rank) == draws.counts(9, 1, n, rank)).all()
        assert not (draws.counts(8, 0, n, rank) == draws.counts(9, 0, n, rank)).all()


def test_counts_are_multinomial():
    """Variance, shares of rows left out and drawn once or twice, and the spread of block totals, as of n draws with replacement."""
    n = 200_000
    m = draws.counts(3, 0, n, np.arange(n))
    assert abs(m.var() - 1) < 0.02
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs((m == k).mean() - share) < 0.005
    totals = np.array([draws.counts(s, 1, 9 * 4096, np.arange(9 * 4096)).reshape(9, 4096).sum(axis=1) for s in range(200)])
    assert abs(totals.mean() - 4096) < 15 and abs(totals.std() / np.sqrt(4096 * 8 / 9) - 1) < 0.1


def test_draws_make_no_exchange(spark, frames):
    c = TreeConfig(n_trees=4, bootstrap="rows", seed=2)
    p = prepared(frames[True], c, binning.edge_lists(binning.bin_edges(frames[True])))
    plan = row_draws(p, c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = row_draws(p, c).groupBy("tree_id").sum("m").collect()
    assert sorted((r[0], r[1]) for r in got) == [(t, 400) for t in range(4)]
    assert sorted(row_draws(p, c).collect()) == sorted(row_draws(p.repartition(7), c).collect())
    assert RandomForestClassifier().bootstrap is True
    m = RandomForestClassifier(n_estimators=2, max_depth=1).fit(p.select(p.row_id.alias("id"), *[p.x[i].alias(f) for i, f in enumerate(NAMES)], "y"), NAMES, "y", "id")
    assert m.trees.config.bootstrap == "rows" and all(m.trees.nodes[t, 0].samples == 400 for t in range(2))


@pytest.mark.parametrize("exact,kind", [(False, "rows"), (True, "rows"), (True, "exact"), (False, "poisson")])
def test_bootstraps_of_both_splitters(frames, exact, kind):
    t = grown(frames[True], exact=exact, bootstrap=kind, max_depth=1)
    assert len(t.tree_ids) == 3
    if kind != "poisson":
        assert all(t.nodes[k, 0].samples == 400 for k in range(3))
    assert len({t.nodes[k, 0].weight for k in range(3)} | {tuple(t.nodes[k, 0].sums) for k in range(3)}) > 2


# --- models in tables ------------------------------------------------------


@pytest.fixture
def in_tables(monkeypatch):
    monkeypatch.setattr(trees, "LOAD_NODES", 0)
    monkeypatch.setattr(trees, "BLOCK_NODES", 25)
    monkeypatch.setattr(score, "CHUNK", 90)


def rows_of(df, *names):
    return sorted(tuple(np.round(v, 9).tolist() if isinstance(v, list | float) else v for v in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("cls,finish_rows", [(True, 60), (False, 10**6)])
def test_a_model_in_a_table_equals_one_on_the_driver(spark, data, in_tables, monkeypatch, cls, finish_rows):
    x, label, value = data
    d = table(spark, x, label if cls else value)
    fit = lambda: (RandomForestClassifier if cls else RandomForestRegressor)(n_estimators=4, max_depth=None, random_state=3, finish_rows=finish_rows).fit(d, NAMES, "y", "id")
    large = fit()
    assert large.trees.rest is not None and len(large.trees.blocks()) > 4
    monkeypatch.setattr(trees, "LOAD_NODES", 10**6)
    small = fit()
    assert small.trees.rest is None
    names = ["id", "prediction", *(["probability"] if cls else [])]
    assert rows_of(large.transform(d), *names) == rows_of(small.transform(d), *names)
    assert rows_of(large.table(spark), "tree_id", "node_id", "is_leaf", "feature", "threshold", "bin", "left_id", "right_id", "value", "samples", "weight", "class_weights", "gain", "lower", "upper") == rows_of(small.table(spark), "tree_id", "node_id", "is_leaf", "feature", "threshold", "bin", "left_id", "right_id", "value", "samples", "weight", "class_weights", "gain", "lower", "upper")
    assert (large.get_depth(), large.get_n_leaves(), large.trees.n_nodes()) == (small.get_depth(), small.get_n_leaves(), len(small.trees.nodes))
    assert np.allclose(large.feature_importances(), small.feature_importances())
    frame = training_frame(d, "id", NAMES, "y")
    names = ["row_id", "tree_id", "value", "leaf"]
    assert rows_of(score.per_tree(frame, large.trees), *names) == rows_of(score.per_tree(frame, small.trees), *names)
    rule = "votes" if cls else "regression"
    for a, b in zip(early_stop.row_report(frame, large.trees, rule).orderBy("c").collect(), early_stop.row_report(frame, small.trees, rule).orderBy("c").collect(), strict=True):
        assert [v is None for v in a] == [v is None for v in b] and np.allclose([v for v in a if v is not None], [v for v in b if v is not None])


def test_boosting_in_tables(spark, data, in_tables, monkeypatch):
    x, label, _ = data
    d = table(spark, x, label)
    fit = lambda: BoostClassifier(n_estimators=2, rf_n_estimators=2, rf_max_depth=None, random_state=3, finish_rows=150, min_samples_leaf=15).fit(d, NAMES, "y", "id")
    large = fit()
    assert all(t.rest is not None for r in large.rounds for t in r)
    monkeypatch.setattr(trees, "LOAD_NODES", 10**6)
    small = fit()
    a, b = (dict(m.raw(d).select("id", "raw").collect()) for m in (large, small))
    assert all(np.allclose(a[k], b[k]) for k in b)
    assert np.allclose(large.feature_importances(), small.feature_importances())
    assert large.table(spark).count() == small.table(spark).count()


def test_a_larger_finish_is_asked_for(frames, monkeypatch):
    monkeypatch.setattr(grow, "MAX_NODES", 6)
    with pytest.raises(ValueError, match="finish_rows"):
        grown(frames[True], max_depth=None, finish_rows=3)
    assert grown(frames[True], max_depth=None, finish_rows=400, n_trees=1).n_nodes() > 6


def test_generations_are_dropped(spark, frames):
    before = set(glob.glob(f"{work_dir(spark).removeprefix('file://')}/*"))
    c = TreeConfig(n_trees=2, bootstrap=False, max_depth=5, finish_rows=0)
    edges = binning.edge_lists(binning.bin_edges(frames[True]))
    p = prepared(frames[True], c, edges)
    grow.grow(p, c, edges, 3)
    left = {x.rsplit("/", 1)[-1].split("-")[0] for x in set(glob.glob(f"{work_dir(spark).removeprefix('file://')}/*")) - before}
    assert "prepared" in left and not left & {"routes", "histogram"}
    dropped(p)
    assert not glob.glob(p.stored_at.removeprefix("file://"))
    dropped(frames[True].select("x"))  # not a table of ours: left alone


# --- guards and the facade -------------------------------------------------


def test_unfitted_models_refuse(spark, data):
    d = table(spark, data[0][:5], data[1][:5])
    empty = BoostModel("binary", NAMES, 2, 0.1, [0.0])
    for use in (lambda: empty.transform(d), lambda: empty.raw(d), lambda: export.to_dict(empty, spark), lambda: ForestModel(Trees(TreeConfig(), None, 3), NAMES, 1, 1).transform(d)):
        with pytest.raises(ValueError, match="not been fitted"):
            use()


def test_legacy_facade(spark, data):
    x, label, value = data
    kw = {"n_estimators": 1, "rf_n_estimators": 2, "rf_max_depth": 2, "random_state": 1}
    d, v = table(spark, x, label), table(spark, x, value)
    assert rows_of(LegacyBoost("classification", **kw).fit(d, NAMES, "y", "id").transform(d), "id", "probability") == rows_of(BoostClassifier(**kw).fit(d, NAMES, "y", "id").transform(d), "id", "probability")
    assert rows_of(LegacyBoost("regression", **kw).fit(v, NAMES, "y", "id").transform(v), "id", "prediction") == rows_of(BoostRegressor(**kw).fit(v, NAMES, "y", "id").transform(v), "id", "prediction")


def test_weights_move_the_balance(spark):
    """A heavier rare class: more rows are told to be of it; the Hessian's weights scale a leaf as in closed form."""
    r = np.random.RandomState(0)
    x, y = r.randn(400, 3), np.zeros(400)
    y[r.permutation(400)[:30]] = 1
    w = np.where(y == 1, 12.0, 1.0)
    d = table(spark, x, y, w)
    kw = {"n_estimators": 2, "rf_n_estimators": 3, "rf_max_depth": 3, "learning_rate": 0.5, "random_state": 2}
    told = [BoostClassifier(**kw).fit(d, NAMES, "y", "id", weight).transform(d).agg({"prediction": "sum"}).first()[0] for weight in (None, "w")]
    assert told[1] > told[0]
