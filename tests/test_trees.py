"""Growth against an independent NumPy grower, and invariants of weights, constraints, export and attribution."""

import numpy as np
import pytest

from copse.operators import binning, early_stop, shapley
from copse.operators.boost import BoostClassifier, BoostRegressor
from copse.operators.forest import DecisionTree, RandomForestClassifier, RandomForestRegressor
from copse.operators.grow import TreeConfig, grow, prepared
from copse.operators.score import per_tree
from copse.sources import export
from copse.sources.frames import training_frame

NAMES = ["a", "b", "c"]


def table(spark, x, y, w=None):
    cols = [list(map(float, v)) for v in x.T]
    w = np.ones(len(y)) if w is None else w
    return spark.createDataFrame([(i, *[c[i] for c in cols], float(y[i]), float(w[i])) for i in range(len(y))], "id long, a double, b double, c double, y double, w double")


@pytest.fixture(scope="module")
def data():
    r = np.random.RandomState(42)
    x = np.round(r.rand(300, 3) * 4, 1)
    return x, (x[:, 0] + x[:, 1] - x[:, 2] > 1.5).astype(float), np.round(2 * x[:, 0] - x[:, 2] + r.randn(300) * 0.1, 3)


def rank_edges(v, bins=256):
    s, n, k = np.sort(v), len(v), min(bins, len(set(v)))
    return [*sorted({s[b * n // k] for b in range(1, k)}), np.inf] if k > 1 else [np.inf]


def impurity(y, w, cls):
    if cls:
        return 1 - sum((w[y == k].sum() / w.sum()) ** 2 for k in set(y))
    return (w * y * y).sum() / w.sum() - ((w * y).sum() / w.sum()) ** 2


def numpy_tree(x, y, w, depth, cls, exact, edges, node=0, out=None):
    out = {} if out is None else out
    out[node] = None
    if depth == 0 or len(y) < 2:
        return out
    best = (1e-12 * max(1, impurity(y, w, cls)), None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in ((v[:-1] + v[1:]) / 2 if exact else edges[f][:-1]):
            left = x[:, f] <= t
            if 0 < left.sum() < len(y) and w[left].sum() > 0 and w[~left].sum() > 0:
                g = impurity(y, w, cls) - (w[left].sum() * impurity(y[left], w[left], cls) + w[~left].sum() * impurity(y[~left], w[~left], cls)) / w.sum()
                if g > best[0] + 1e-12:
                    best = (g, (f, t))
    if best[1]:
        f, t = out[node] = best[1]
        left = x[:, f] <= t
        numpy_tree(x[left], y[left], w[left], depth - 1, cls, exact, edges, 2 * node + 1, out)
        numpy_tree(x[~left], y[~left], w[~left], depth - 1, cls, exact, edges, 2 * node + 2, out)
    return out


@pytest.mark.parametrize("task,splitter", [("classification", "hist"), ("classification", "exact"), ("regression", "hist"), ("regression", "exact")])
def test_same_tree_as_numpy(spark, data, task, splitter):
    x, label, value = data
    y = label if task == "classification" else value
    m = DecisionTree(max_depth=3, task=task, splitter=splitter).fit(table(spark, x, y), NAMES, "y", "id")
    want = numpy_tree(x, y, np.ones(len(y)), 3, task == "classification", splitter == "exact", [rank_edges(x[:, f]) for f in range(3)])
    got = {i: None if n.is_leaf else (n.feature, n.threshold) for (_, i), n in m.trees.nodes.items()}
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert got[i] is None if s is None else got[i][0] == s[0] and abs(got[i][1] - s[1]) < 1e-9


def test_edges_rule(spark):
    """Balanced 0/1 values get no edge at 0; with nine tenths zeros they do."""
    for zeros, want in ((5, [1.0, np.inf]), (1, [1.0, np.inf]), (9, [0.0, np.inf])):
        d = spark.createDataFrame([(i, float(i >= zeros), 0.0) for i in range(10)], "id long, a double, y double")
        assert binning.edge_lists(binning.bin_edges(training_frame(d, "id", ["a"], "y"))) == [want]
    d = spark.createDataFrame([(i, 3.0, 0.0) for i in range(10)], "id long, a double, y double")
    assert binning.edge_lists(binning.bin_edges(training_frame(d, "id", ["a"], "y"))) == [[np.inf]]


def probabilities(m, df):
    return [r[0][1] for r in m.transform(df).orderBy("id").select("probability").collect()]


def test_weights(spark, data):
    x, y, _ = data
    r = np.random.RandomState(0)
    w = r.randint(0, 3, len(y)).astype(float)
    kw = {"n_estimators": 1, "rf_n_estimators": 1, "rf_max_depth": 2, "bootstrap": False, "use_histogram": False}
    fit = lambda df, weight: BoostClassifier(**kw).fit(df, NAMES, "y", "id", weight)
    plain = table(spark, x, y)
    base = probabilities(fit(table(spark, x, y, w), "w"), plain)
    assert np.allclose(probabilities(fit(plain, None), plain), probabilities(fit(plain, "w"), plain))
    assert np.allclose(base, probabilities(fit(table(spark, x, y, 7 * w), "w"), plain))
    at = np.repeat(np.arange(len(y)), w.astype(int))
    assert np.allclose(base, probabilities(fit(table(spark, x[at], y[at]), None), plain))
    with pytest.raises(ValueError):
        fit(table(spark, x, y, w - 1), "w")


@pytest.mark.parametrize("hist", [True, False])
def test_closed_form_newton_leaf(spark, hist):
    r = np.random.RandomState(1)
    y, w = (r.rand(200) < 0.3).astype(float), r.uniform(0.5, 5, 200)
    d = table(spark, np.ones((200, 3)), y, w)
    m = BoostClassifier(n_estimators=1, rf_n_estimators=1, bootstrap=False, use_histogram=hist).fit(d, NAMES, "y", "id", "w")
    p = (w * y).sum() / w.sum()
    leaf = (w * (y - p)).sum() / (w * p * (1 - p)).sum()
    want = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + 0.1 * leaf)))
    assert abs(probabilities(m, d)[0] - want) < 1e-9


def test_monotone(spark):
    r = np.random.RandomState(0)
    x = r.randn(600, 3)
    z = 1.6 * x[:, 0] ** 2 - x[:, 1]
    y = (r.rand(600) < 1 / (1 + np.exp(-(z - z.mean())))).astype(float)
    kw = {"n_estimators": 2, "rf_n_estimators": 2, "rf_max_depth": 3, "random_state": 1, "learning_rate": 0.5}
    grid = np.zeros((50, 3))
    grid[:, 0] = np.linspace(-3, 3, 50)
    sweep, d = table(spark, grid, np.zeros(50)), table(spark, x, y)
    up = probabilities(BoostClassifier(**kw, monotone_constraints={"a": 5}).fit(d, NAMES, "y", "id"), sweep)
    down = probabilities(BoostClassifier(**kw, monotone_constraints={0: -1}).fit(d, NAMES, "y", "id"), sweep)
    free = probabilities(BoostClassifier(**kw).fit(d, NAMES, "y", "id"), sweep)
    assert (np.diff(up) >= -1e-9).all() and (np.diff(down) <= 1e-9).all()
    assert (np.diff(free) < -1e-9).any() and (np.diff(free) > 1e-9).any()
    with pytest.raises(ValueError):
        BoostClassifier(**kw, monotone_constraints={"zz": 1}).fit(d, NAMES, "y", "id")


@pytest.mark.parametrize("kind", ["binary", "multiclass", "regression"])
def test_export_round_trip(spark, data, kind):
    x, y, v = data
    kw = {"n_estimators": 2, "rf_n_estimators": 2, "rf_max_depth": 2, "random_state": 3}
    target = {"binary": y, "multiclass": np.minimum((x[:, 0] * 0.7).astype(int), 2), "regression": v}[kind]
    d = table(spark, x, target)
    m = (BoostRegressor(**kw) if kind == "regression" else BoostClassifier(**kw)).fit(d, NAMES, "y", "id")
    e = export.to_dict(m, spark)
    assert e["task"] == kind
    want = export.predict_from_dict(e, x[:40].tolist())
    got = [r["raw"] for r in m.raw(d).orderBy("id").limit(40).collect()]
    assert np.allclose(got, want, atol=1e-12)
    if kind == "regression":
        ci = m.predict_ci(d).select("prediction", "ci_low", "ci_high").first()
        assert ci["ci_low"] < ci["prediction"] < ci["ci_high"]


@pytest.mark.parametrize("depth", [3, 5])
def test_shap_efficiency_and_enumeration(spark, data, depth):
    x, y, _ = data
    d = table(spark, x, y)
    m = DecisionTree(max_depth=depth).fit(d, NAMES, "y", "id")
    frame = training_frame(d, "id", NAMES, "y")
    phi = {(r["row_id"], r["feature"]): r["phi"] for r in shapley.explain(frame, m.trees, frame).filter("output = 1").collect()}
    base, p = shapley.base_values(m.trees, frame)[1], probabilities(m, d)
    assert all(abs(base + sum(phi[i, f] for f in range(3)) - p[i]) < 1e-10 for i in range(len(y)))
    cover = shapley.covers(m.trees, frame)

    def value(i, row, known):
        n = m.trees.nodes[0, i]
        if n.is_leaf:
            return m.trees.shares(n)[1]
        kids = 2 * i + 1, 2 * i + 2
        if n.feature in known:
            return value(kids[int(row[n.feature] > n.threshold)], row, known)
        return sum(cover[k] / n.samples * value(k, row, known) for k in kids)

    from itertools import combinations
    from math import factorial

    for i in range(0, 300, 60):
        for f in range(3):
            rest = [k for k in range(3) if k != f]
            want = sum(factorial(s) * factorial(2 - s) / 6 * (value(0, x[i], {*c, f}) - value(0, x[i], set(c))) for s in range(3) for c in combinations(rest, s))
            assert abs(want - phi[i, f]) < 1e-10


def test_quality_floors(spark):
    r = np.random.RandomState(5)
    x = r.randn(800, 3)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * x[:, 2] * x[:, 1] > 0).astype(float)
    d = table(spark, x, y)
    assert RandomForestClassifier(n_estimators=10, max_depth=5, max_features="sqrt", random_state=1).fit(d, NAMES, "y", "id").score(d, "y") > 0.85
    p = np.array(probabilities(BoostClassifier(n_estimators=3, rf_n_estimators=5, rf_max_depth=4, learning_rate=0.3).fit(d, NAMES, "y", "id"), d))
    a, b = p[y == 1], p[y == 0]
    assert (a[:, None] > b[None]).mean() > 0.95
    v = table(spark, x, 2 * x[:, 0] - x[:, 1])
    m = RandomForestRegressor(n_estimators=6, max_depth=5, random_state=2).fit(v, NAMES, "y", "id")
    e = np.array([(q["y"], q["prediction"]) for q in m.transform(v).collect()])
    assert 1 - ((e[:, 0] - e[:, 1]) ** 2).sum() / ((e[:, 0] - e[:, 0].mean()) ** 2).sum() > 0.3


def test_early_stop_uses_fewer_trees(spark, data):
    x, y, _ = data
    d = table(spark, x, y)
    m = RandomForestClassifier(n_estimators=60, max_depth=3, async_mode=True, random_state=1).fit(d, NAMES, "y", "id")
    assert 3 <= m.trees_used < 60
    assert len({t for t, _ in m.trees.nodes}) == m.trees_used


@pytest.mark.parametrize("rule", ["votes", "regression", "updates"])
def test_stop_rules_in_the_scoring_pass_equal_their_tables(spark, data, rule, monkeypatch):
    monkeypatch.setattr(early_stop, "CELLS", 400)
    x, y, _ = data
    c = TreeConfig(rule == "votes", 2, 4, max_depth=2, max_features=1, bootstrap="poisson", seed=3)
    frame = training_frame(table(spark, x, y), "id", NAMES, "y")
    edges = binning.edge_lists(binning.bin_edges(frame))
    p = prepared(frame, c, edges)
    trees = grow(p, c, edges, 3)
    preds = per_tree(p, trees)
    want = early_stop.stability_votes(preds, 2) if rule == "votes" else early_stop.stability_regression(preds) if rule == "regression" else early_stop.stability_updates(preds)
    got = early_stop.row_report(p, trees, rule)
    assert got.columns == want.columns
    for a, b in zip(got.orderBy("c").collect(), want.orderBy("c").collect(), strict=True):
        assert [v is None for v in a] == [v is None for v in b]
        assert np.allclose([v for v in a if v is not None], [v for v in b if v is not None], atol=1e-9)


@pytest.mark.parametrize("rule", ["votes", "regression"])
def test_states_go_on_from_batch_to_batch(spark, data, rule, monkeypatch):
    """Reports of later trees on top of the rows' state are those of all trees at once."""
    x, y, _ = data
    c = TreeConfig(rule == "votes", 2, 5, max_depth=2, max_features=1, bootstrap="poisson", seed=3)
    frame = training_frame(table(spark, x, y), "id", NAMES, "y")
    edges = binning.edge_lists(binning.bin_edges(frame))
    p = prepared(frame, c, edges).drop("x")
    one, two = grow(p, c, edges, 3, [0, 1, 2]), grow(p, c, edges, 3, [3, 4])
    later = early_stop.row_report(early_stop.merged_state(p, one, rule), two, rule, 3).orderBy("c").collect()
    one.add(two)
    want = early_stop.row_report(p, one, rule).filter("c > 3").orderBy("c").collect()
    assert [r["c"] for r in later] == [4, 5]
    for a, b in zip(later, want, strict=True):
        assert np.allclose(list(a), list(b), atol=1e-12)


def test_checks(spark, data):
    x, y, _ = data
    bad = x.copy()
    bad[7, 1] = np.nan
    with pytest.raises(ValueError, match="row 7, column b"):
        DecisionTree().fit(table(spark, bad, y), NAMES, "y", "id")
    with pytest.raises(ValueError):
        DecisionTree().fit(table(spark, x, y + 1), NAMES, "y", "id")


def test_streaming_scores_equal_batch(spark, data, tmp_path):
    from copse.streaming.scoring import score_stream

    x, y, _ = data
    d = table(spark, x, y)
    m = RandomForestClassifier(n_estimators=3, max_depth=3).fit(d, NAMES, "y", "id")
    d.write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), m, str(tmp_path / "cp"), path=str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    assert probabilities(m, d) == [r["probability"][1] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()]


def test_bootstrap_has_n_draws(spark, data):
    x, y, _ = data
    c = TreeConfig(n_trees=3, bootstrap="exact", seed=4, max_depth=2)
    frame = training_frame(table(spark, x, y), "id", NAMES, "y")
    edges = binning.edge_lists(binning.bin_edges(frame))
    p = prepared(frame, c, edges)
    assert [sum(r["m"][t] for r in p.collect()) for t in range(3)] == [300] * 3
    assert all(grow(p, c, edges, 3).nodes[t, 0].samples == 300 for t in range(3))
