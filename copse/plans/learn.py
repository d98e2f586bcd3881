"""Queries of validation, priors, binning, splits, trees and forests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from copse.functions.scalar import draw
from copse.operators import binning, boost, score, split, validate
from copse.operators.forest import DecisionTree, RandomForestClassifier, RandomForestRegressor
from copse.operators.grow import TreeConfig, bootstrap_counts, grow, prepared
from copse.operators.score import per_tree
from copse.operators.trees import features_tried
from copse.plans import oracle as o
from copse.sources.frames import customer_frame, orders_frame, read_table, training_frame, with_rank

FS, CS = ["f0", "f1", "f2", "f3"], ["f0", "f1", "f2"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _orders(spark, sf):
    d = orders_frame(spark, sf)
    return d, training_frame(d, "rid", FS, "y")


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# --- validation and priors -------------------------------------------------


@query("""WITH c AS (SELECT *, isnan(l_quantity) OR isinf(l_quantity) OR l_quantity IS NULL AS b0, isnan(l_discount) OR isinf(l_discount) OR l_discount IS NULL AS b1 FROM lineitem)
    SELECT CAST(sum(CAST(b0 AS INT) + CAST(b1 AS INT)) AS BIGINT) AS n_bad, min(CASE WHEN b0 OR b1 THEN l_orderkey END) AS first_row, CAST(NULL AS INT) AS first_col FROM c""")
def validate_finite(spark, sf):
    return validate.finite_report(read_table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"])


@query("SELECT count(*) AS n, CAST(sum(CAST(l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax) AS INT)) AS BIGINT) AS n_not_finite, CAST(sum(CAST(l_tax < 0 AS INT)) AS BIGINT) AS n_negative FROM lineitem")
def validate_weights(spark, sf):
    return validate.weights_report(read_table(spark, sf, "lineitem"), "l_tax")


CODE = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


def _coded(spark, sf):
    return orders_frame(spark, sf).withColumn("label", F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2).cast("double"))


@query(f"SELECT DISTINCT {CODE} AS label FROM orders")
def class_labels(spark, sf):
    return validate.classes(_coded(spark, sf), "label")


@query(f"SELECT {CODE} AS label, round(ln(least(greatest(count(*) / (SELECT count(*) FROM orders), 1e-5), 1 - 1e-5)), 6) AS init FROM orders GROUP BY 1")
def class_priors(spark, sf):
    return boost.class_priors(training_frame(_coded(spark, sf), "rid", FS, "label")).select("label", r6("init", "init"))


@query("WITH m AS (SELECT avg(CAST(o_orderstatus = 'F' AS INT)) AS p FROM orders) SELECT round(ln(p / (1 - p)), 6) AS init FROM m")
def binary_prior_logit(spark, sf):
    return boost.binary_prior(_orders(spark, sf)[1]).select(r6("init", "init"))


@query("SELECT round(avg(o_totalprice), 4) AS init FROM orders")
def regression_init(spark, sf):
    d = orders_frame(spark, sf)
    return boost.regression_init(training_frame(d, "rid", FS, "f0")).select(F.round("init", 4).alias("init"))


@query("SELECT count(*) AS n, sum(CAST(o_orderpriority < '3' AS INT)) AS kept FROM orders")
def split_predicate(spark, sf):
    d = orders_frame(spark, sf)
    return d.agg(F.count("*").alias("n"), F.sum((F.col("f1") <= 2.5).cast("int")).alias("kept"))


# --- bins ------------------------------------------------------------------

_BASE = (o.frame_sql("orders"), o.long_sql(4), o.EDGES)


@query(o.query(*_BASE, final="SELECT feature, bin, edge FROM ed"))
def bin_edges(spark, sf):
    return binning.bin_edges(_orders(spark, sf)[1])


@query(o.query("lg AS (SELECT event_id AS rid, 0.0::DOUBLE AS y, 1.0::DOUBLE AS w, 0 AS feature, value AS v FROM events)", o.EDGES, final="SELECT feature, bin, edge FROM ed"))
def bin_edges_events(spark, sf):
    e = read_table(spark, sf, "events")
    return binning.bin_edges(training_frame(e.withColumn("y", F.lit(0.0)), "event_id", ["value"], "y"))


@query(o.query(*_BASE, o.BINNED, final="SELECT feature, CAST(bin AS INT) AS bin, count(*) AS n FROM bn GROUP BY 1, 2"))
def bin_counts(spark, sf):
    _, frame = _orders(spark, sf)
    b = binning.assign_bins(frame, binning.edge_lists(binning.bin_edges(frame)))
    return b.select(F.posexplode("b").alias("feature", "bin")).groupBy("feature", "bin").agg(F.count("*").alias("n"))


def _rooted(spark, sf, target="y", weight=None):
    d = orders_frame(spark, sf).withColumn("wt", (F.col("rid") % 3).cast("double"))
    frame = training_frame(d, "rid", FS, target, weight)
    edges = binning.edge_lists(binning.bin_edges(frame))
    rows = binning.assign_bins(frame, edges).select("*", F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), F.lit(1).alias("m"))
    return rows, edges


def _exact_rows(spark, sf, target="y"):
    _, frame = _orders(spark, sf)
    if target != "y":
        frame = training_frame(orders_frame(spark, sf), "rid", FS, target)
    return frame.select("*", F.col("x").alias("b"), F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), F.lit(1).alias("m"))


def _class2():
    return split.class_sums(F.col("y"), F.col("w"), 2)


def _moments():
    return split.moment_sums(F.col("y"), F.col("w"))


_G = o.hist_sql(o.GINI2)


@query(o.query(*_BASE, o.BINNED, _G, final="SELECT feature, CAST(bin AS INT) AS bin, n, round(w, 6) AS w, round(s0, 6) AS c0, round(s1, 6) AS c1 FROM h"))
def node_hist_gini(spark, sf):
    h = split.histogram(_rooted(spark, sf)[0], _class2(), 2)
    return h.select("feature", F.col("bin").cast("int").alias("bin"), "n", r6("w", "w"), r6(F.col("s")[0], "c0"), r6(F.col("s")[1], "c1"))


_V = "fr AS (SELECT rid, f0, f1, f2, f3, f1 AS y, w, status FROM fr0)"
_VBASE = (o.frame_sql("orders").replace("fr AS", "fr0 AS", 1), _V, o.long_sql(4), o.EDGES)


@query(o.query(*_VBASE, o.BINNED, o.hist_sql(o.MOMENTS), final="SELECT feature, CAST(bin AS INT) AS bin, n, round(s0, 6) AS wy, round(s1, 6) AS wyy FROM h"))
def node_hist_variance(spark, sf):
    h = split.histogram(_rooted(spark, sf, "f1")[0], _moments(), 2)
    return h.select("feature", F.col("bin").cast("int").alias("bin"), "n", r6(F.col("s")[0], "wy"), r6(F.col("s")[1], "wyy"))


_TOP = "SELECT feature, bin, n_left, gain FROM (SELECT feature, CAST(bin AS INT) AS bin, CAST(ln AS BIGINT) AS n_left, round(gain, 10) AS gain FROM cbest)"


def _shown(best):
    return best.select("feature", F.col("bin").cast("int").alias("bin"), F.col("ln").cast("long").alias("n_left"), F.round("gain", 10).alias("gain"))


@query(o.query(*_BASE, o.BINNED, _G, o.cand_sql(2, True), final=_TOP))
def best_split_gini_hist(spark, sf):
    return _shown(split.best(split.candidates(split.histogram(_rooted(spark, sf)[0], _class2(), 2), 2, True)))


# target month for the variance queries, with price, priority and year as features
_M = "fr AS (SELECT rid, f0, f1, f3 AS f2, f2 AS y, w FROM fr0)"
_MBASE = (o.frame_sql("orders").replace("fr AS", "fr0 AS", 1), _M, o.long_sql(3), o.EDGES)


def _month_rows(spark, sf, exact=False):
    d = orders_frame(spark, sf)
    frame = training_frame(d, "rid", ["f0", "f1", "f3"], "f2")
    b = frame.withColumn("b", F.col("x")) if exact else binning.assign_bins(frame, binning.edge_lists(binning.bin_edges(frame)))
    return b.select("*", F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), F.lit(1).alias("m"))


@query(o.query(*_MBASE, o.BINNED, o.hist_sql(o.MOMENTS), o.cand_sql(2, False), final=_TOP))
def best_split_variance_hist(spark, sf):
    return _shown(split.best(split.candidates(split.histogram(_month_rows(spark, sf), _moments(), 2), 2, False)))


_EXACT_TOP = "SELECT feature, round(thr, 6) AS threshold, CAST(ln AS BIGINT) AS n_left, round(gain, 10) AS gain FROM cbest"


def _shown_exact(best):
    return best.select("feature", r6("threshold", "threshold"), F.col("ln").cast("long").alias("n_left"), F.round("gain", 10).alias("gain"))


@query(o.query(o.frame_sql("orders"), o.long_sql(4), o.hist_sql(o.GINI2, "lg", "v"), o.cand_sql(2, True, True), final=_EXACT_TOP))
def best_split_gini_exact(spark, sf):
    return _shown_exact(split.best(split.candidates(split.histogram(_exact_rows(spark, sf), _class2(), 2), 2, True, exact=True)))


@query(o.query(*_MBASE[:3], o.hist_sql(o.MOMENTS, "lg", "v"), o.cand_sql(2, False, True), final=_EXACT_TOP))
def best_split_variance_exact(spark, sf):
    return _shown_exact(split.best(split.candidates(split.histogram(_month_rows(spark, sf, True), _moments(), 2), 2, False, exact=True)))


_WBASE = (o.frame_sql("orders").replace("fr AS", "fr0 AS", 1), "fr AS (SELECT * REPLACE (CAST(rid % 3 AS DOUBLE) AS w) FROM fr0)", o.long_sql(4), o.EDGES)


@query(o.query(*_WBASE, o.BINNED, _G, o.cand_sql(2, True), final=_TOP))
def best_split_weighted(spark, sf):
    return _shown(split.best(split.candidates(split.histogram(_rooted(spark, sf, weight="wt")[0], _class2(), 2), 2, True)))


_MONO = "AND (feature <> 0 OR ls0 / lw <= rs0 / rw) AND (feature <> 2 OR ls0 / lw >= rs0 / rw)"


@query(o.query(*_MBASE, o.BINNED, o.hist_sql(o.MOMENTS), o.cand_sql(2, False, extra=_MONO), final=_TOP))
def best_split_monotone(spark, sf):
    return _shown(split.best(split.candidates(split.histogram(_month_rows(spark, sf), _moments(), 2), 2, False, monotone=[1, 0, -1])))


# --- trees -----------------------------------------------------------------

_ROOT = (*_BASE, o.BINNED, _G, o.cand_sql(2, True))
_LEAVES = "nd AS (SELECT bn.rid, bn.y, bn.w, CASE WHEN bn.bin <= b.bin THEN 1 ELSE 2 END AS node FROM bn JOIN cbest b ON bn.feature = b.feature)"


def _stump(spark, sf, depth=1):
    d = orders_frame(spark, sf)
    return d, DecisionTree(max_depth=depth, splitter="hist").fit(d, FS, "y", "rid")


@query(o.query(*_ROOT, _LEAVES, final="SELECT CAST(node AS BIGINT) AS node_id, count(*) AS n, round(avg(y), 6) AS share, CAST(avg(y) >= 0.5 AS INT) AS predicted FROM nd GROUP BY 1"))
def stump_leaves(spark, sf):
    d, m = _stump(spark, sf)
    leaf = score.case_expression(m.trees, [F.col(c) for c in FS], what="leaf").alias("node_id")
    value = score.case_expression(m.trees, [F.col(c) for c in FS])
    return d.select(leaf, "y", value.alias("v")).groupBy("node_id").agg(F.count("*").alias("n"), r6(F.avg("y"), "share"), F.max("v").cast("int").alias("predicted"))


_SECOND = (
    "bn1 AS (SELECT bn.*, nd.node FROM bn JOIN nd USING (rid))",
    o.hist_sql(o.GINI2, "bn1", group="node", name="h1"),
    o.cand_sql(2, True, name="d", hist="h1"),
    """lf AS (SELECT r.rid, r.y, CASE WHEN d.feature IS NULL THEN r.node WHEN b.bin <= d.bin THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS leaf
        FROM nd r LEFT JOIN dbest d ON d.node = r.node LEFT JOIN bn b ON b.rid = r.rid AND b.feature = d.feature)""",
)


@query(o.query(*_ROOT, _LEAVES, *_SECOND, final="SELECT CAST(leaf AS BIGINT) AS leaf, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM lf GROUP BY 1"))
def tree_depth2_predict(spark, sf):
    d, m = _stump(spark, sf, 2)
    leaf = score.case_expression(m.trees, [F.col(c) for c in FS], what="leaf").alias("leaf")
    return d.select(leaf, "y").groupBy("leaf").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query(o.query(*_ROOT, _LEAVES, *_SECOND, "pr AS (SELECT leaf, avg(y) AS p FROM lf GROUP BY leaf)", final="SELECT rid, round(1 - p, 6) AS p0, round(p, 6) AS p1 FROM lf JOIN pr USING (leaf)"))
def tree_proba(spark, sf):
    d, m = _stump(spark, sf, 2)
    p = m.transform(d.select("rid", *FS))
    return p.select("rid", r6(F.col("probability")[0], "p0"), r6(F.col("probability")[1], "p1"))


@query(o.query(*_ROOT, _LEAVES, *_SECOND, final="SELECT CAST(2 AS INT) AS depth, CAST(count(DISTINCT leaf) AS INT) AS n_leaves, CAST(1 + count(DISTINCT CASE WHEN leaf > 2 THEN (leaf - 1) // 2 END) AS INT) AS n_internal FROM lf"))
def tree_shape(spark, sf):
    _, m = _stump(spark, sf, 2)
    return m.table(spark).agg(F.max("depth").cast("int").alias("depth"), F.sum(F.col("is_leaf").cast("int")).cast("int").alias("n_leaves"), F.sum((~F.col("is_leaf")).cast("int")).cast("int").alias("n_internal"))


@query(o.query(*_MBASE, o.BINNED, o.hist_sql(o.MOMENTS), o.cand_sql(2, False, extra=_MONO), final="""SELECT feature, round((ls0 / lw + rs0 / rw) / 2, 6) AS mid,
    round(CASE WHEN feature = 2 THEN greatest(ls0 / lw, (ls0 / lw + rs0 / rw) / 2) ELSE ls0 / lw END, 6) AS left_value, round(rs0 / rw, 6) AS right_value FROM cbest"""))
def monotone_bounds(spark, sf):
    d = orders_frame(spark, sf)
    frame = training_frame(d, "rid", ["f0", "f1", "f3"], "f2")
    edges = binning.edge_lists(binning.bin_edges(frame))
    config = TreeConfig(False, max_depth=1, monotone=[1, 0, -1])
    t = grow(prepared(frame, config, edges), config, edges, 3)
    root, left, right = t.nodes[0, 0], t.nodes[0, 1], t.nodes[0, 2]
    mid = (left.sums[0] / left.weight + right.sums[0] / right.weight) / 2
    return spark.createDataFrame([(root.feature, round(mid, 6), round(t.value(left), 6), round(t.value(right), 6))], "feature int, mid double, left_value double, right_value double")


@query(o.query(*_ROOT, _LEAVES, *_SECOND, final="""SELECT CAST(feature AS INT) AS feature, CAST(sum(samples) AS BIGINT) AS samples FROM (
    SELECT feature, tn AS samples FROM cbest UNION ALL SELECT feature, tn FROM dbest) GROUP BY 1"""))
def feature_importance(spark, sf):
    _, m = _stump(spark, sf, 2)
    return m.table(spark).filter("not is_leaf").groupBy("feature").agg(F.sum("samples").alias("samples"))


_EXACT = (*_BASE, o.BINNED, "tg AS (SELECT rid, y, w FROM fr)", *o.forest_sql("a", 0, 1, 3, "tg", classification=True, boot=False, exact=True))


@query(o.kept(o.query(*_EXACT, final="SELECT node AS node_id, feature, round(bin, 6) AS threshold, samples FROM anodes")))
def tree_exact_nodes(spark, sf):
    """DecisionTree's own splitter: midpoints of distinct values."""
    m = DecisionTree(max_depth=3).fit(orders_frame(spark, sf), FS, "y", "rid")
    return m.table(spark).select("node_id", "feature", r6("threshold", "threshold"), "samples")


_MONTH = ("tg AS (SELECT rid, y, w FROM fr)", *o.forest_sql("a", 0, 1, 3, "tg", boot=False, exact=True))


@query(o.kept(o.query(*_MBASE, o.BINNED, *_MONTH, final="SELECT rid, round(v, 6) AS prediction FROM amean")))
def tree_exact_regression(spark, sf):
    d = orders_frame(spark, sf).select("rid", "f0", "f1", F.col("f3").alias("g2"), F.col("f2").alias("month"))
    m = DecisionTree(max_depth=3, task="regression").fit(d, ["f0", "f1", "g2"], "month", "rid")
    return m.transform(d.select("rid", "f0", "f1", "g2")).select("rid", r6("prediction", "prediction"))


# --- bootstrap and forests -------------------------------------------------

_BOOT = f"""cu AS (SELECT c_custkey AS rid, row_number() OVER (ORDER BY c_custkey) - 1 AS rank, count(*) OVER () AS n FROM customer),
    dr AS (SELECT CAST(id // n AS INT) AS tree_id, {o.draw_sql(7, "'boot'", 'id')} % n AS rank FROM (SELECT DISTINCT n FROM cu), range(0, 5 * (SELECT count(*) FROM customer)) t(id)),
    bt AS (SELECT tree_id, rank, CAST(count(*) AS INT) AS m FROM dr GROUP BY ALL)"""


@query(o.query(_BOOT, final="SELECT tree_id, rid, m FROM bt JOIN cu USING (rank)"))
def bootstrap_multiplicity(spark, sf):
    c = with_rank(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("rid")), ["rid"])
    return bootstrap_counts(spark, c.count(), 5, 7).join(c, "rank").select("tree_id", "rid", "m")


@query(o.query(_BOOT, final="SELECT t.tree_id, cu.rid FROM cu, (SELECT DISTINCT tree_id FROM bt) t ANTI JOIN bt ON bt.tree_id = t.tree_id AND bt.rank = cu.rank".replace("ANTI JOIN bt ON", "WHERE NOT EXISTS (SELECT 1 FROM bt WHERE") + ")"))
def oob_rows(spark, sf):
    c = with_rank(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("rid")), ["rid"])
    every = c.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return every.join(bootstrap_counts(spark, c.count(), 5, 7), ["tree_id", "rank"], "left_anti").select("tree_id", "rid")


@query(f"""WITH f AS (SELECT CAST(c_nationkey AS INT) AS tree_id, c_custkey AS node_id, CAST(f AS INT) AS feature, {o.draw_sql(3, "'feat'", 'c_nationkey', 'c_custkey', 'f')} AS h FROM customer, range(0, 6) c(f))
    SELECT tree_id, node_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY h, feature) AS r FROM f) WHERE r <= 2""")
def feature_subset(spark, sf):
    """Features tried at nodes named by the customers' keys."""
    config = TreeConfig(max_features=2, seed=3)
    nodes = read_table(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("tree_id"), F.col("c_custkey").cast("long").alias("node_id"))
    return nodes.select("tree_id", "node_id", F.explode(features_tried(config, 6, F.col("tree_id"), F.col("node_id"))).alias("feature"))


_CROWS = (o.frame_sql("customer"), o.long_sql(3), o.EDGES, o.BINNED, _BOOT)
_FOREST = (
    "tb AS (SELECT bt.tree_id, bn.feature, bn.bin, bn.y, bn.w * bt.m AS w, bt.m FROM bn JOIN cu USING (rid) JOIN bt ON bt.rank = cu.rank)",
    "h AS (SELECT tree_id AS node, feature, bin, CAST(sum(m) AS BIGINT) AS n, sum(w) AS w, sum(CASE WHEN y = 0 THEN w ELSE 0.0 END) AS s0, sum(CASE WHEN y = 1 THEN w ELSE 0.0 END) AS s1 FROM tb GROUP BY ALL)",
    o.cand_sql(2, True),
    "sc AS (SELECT bn.rid, bn.y, c.node AS tree_id, CASE WHEN bn.bin <= c.bin THEN c.ls1 / c.lw ELSE c.rs1 / c.rw END AS p1, CASE WHEN bn.bin <= c.bin THEN c.ls1 >= c.ls0 ELSE c.rs1 >= c.rs0 END AS vote FROM bn JOIN cbest c ON bn.feature = c.feature)",
)


def _stump_forest(spark, sf):
    d = customer_frame(spark, sf)
    return d, RandomForestClassifier(n_estimators=5, max_depth=1, bootstrap="exact", random_state=7).fit(d, CS, "y", "rid")


@query(o.query(*_CROWS, *_FOREST, final="SELECT rid, round(avg(p1), 6) AS p1 FROM sc GROUP BY rid"))
def forest_stump_mean(spark, sf):
    d, m = _stump_forest(spark, sf)
    return m.transform(d.select("rid", *CS)).select("rid", r6(F.col("probability")[1], "p1"))


@query(o.query(*_CROWS, *_FOREST, final="SELECT rid, CAST(avg(p1) >= 1 - avg(p1) AS INT) AS predicted FROM sc GROUP BY rid"))
def forest_vote_argmax(spark, sf):
    d, m = _stump_forest(spark, sf)
    return m.transform(d.select("rid", *CS)).select("rid", F.col("prediction").alias("predicted"))


@query(o.query(*_CROWS, *_FOREST, "p AS (SELECT rid, max(y) AS y, CAST(avg(p1) >= 1 - avg(p1) AS INT) AS k FROM sc GROUP BY rid)", final="SELECT round(avg(CAST(k = y AS INT)), 6) AS accuracy FROM p"))
def accuracy_score(spark, sf):
    d, m = _stump_forest(spark, sf)
    return spark.createDataFrame([(round(m.score(d, "y"), 6),)], "accuracy double")


_ACCT = (o.frame_sql("customer").replace("fr AS", "fr0 AS", 1), "fr AS (SELECT rid, f0, f2 AS f1, f1 AS y, w FROM fr0)", o.long_sql(2), o.EDGES, o.BINNED, "tg AS (SELECT rid, y, w FROM fr)")


@query(o.kept(o.query(*_ACCT, *o.forest_sql("a", 1, 10, 4, "tg"), final="SELECT rid, round(v, 6) AS prediction FROM amean")))
def forest_regressor(spark, sf):
    d = customer_frame(spark, sf)
    m = RandomForestRegressor(n_estimators=10, max_depth=4, bootstrap="exact", random_state=1).fit(d, ["f0", "f2"], "f1", "rid")
    return m.transform(d.select("rid", "f0", "f2")).select("rid", r6("prediction", "prediction"))


@query()
def forest_classifier_table(spark, sf):
    d = orders_frame(spark, sf)
    return RandomForestClassifier(n_estimators=8, max_depth=4, max_features="sqrt", bootstrap="exact", random_state=1).fit(d, FS, "y", "rid").table(spark)


_SQRT = (*_BASE, o.BINNED, "tg AS (SELECT rid, y, w FROM fr)", *o.forest_sql("a", 1, 6, 4, "tg", classification=True, pick=2))


@query(o.kept(o.query(*_SQRT, final="SELECT CAST(node // 1000 AS INT) AS tree_id, node % 1000 AS node_id, feature, bin, samples FROM anodes")))
def forest_sqrt_nodes(spark, sf):
    """Bagged trees of depth 4 with two of four features tried at each node."""
    d = orders_frame(spark, sf)
    m = RandomForestClassifier(n_estimators=6, max_depth=4, max_features="sqrt", bootstrap="exact", random_state=1).fit(d, FS, "y", "rid")
    return m.table(spark).select("tree_id", "node_id", "feature", "bin", "samples")


@query(o.kept(o.query(*_SQRT, final="SELECT rid, round(v, 6) AS p1, CAST(v >= 1 - v AS INT) AS predicted FROM amean")))
def forest_sqrt_proba(spark, sf):
    d = orders_frame(spark, sf)
    m = RandomForestClassifier(n_estimators=6, max_depth=4, max_features="sqrt", bootstrap="exact", random_state=1).fit(d, FS, "y", "rid")
    return m.transform(d.select("rid", *FS)).select("rid", r6(F.col("probability")[1], "p1"), F.col("prediction").alias("predicted"))


@query()
def forest_poisson(spark, sf):
    d = orders_frame(spark, sf)
    return RandomForestClassifier(n_estimators=6, max_depth=3, bootstrap="poisson", random_state=2).fit(d, FS, "y", "rid").table(spark)


# --- unlimited depth -------------------------------------------------------

_CUSTOMERS = (o.frame_sql("customer"), o.long_sql(3), o.EDGES, o.BINNED)
_LEAF = """lf AS (SELECT rid, node % 16 AS tree_id, arg_max(node, depth) AS node, CAST(max(depth) AS INT) AS depth FROM arows GROUP BY rid, node % 16),
    sh AS (SELECT lf.node, sum(a.m * fr.y) / sum(a.m) AS p1, CAST(sum(a.m) AS BIGINT) AS samples FROM lf JOIN arows a ON a.rid = lf.rid AND a.node = lf.node JOIN fr ON fr.rid = lf.rid WHERE a.m > 0 GROUP BY lf.node)"""


def _leaves_of(model, d, names):
    """(rid, tree_id, leaf, depth) of every row and tree."""
    got = per_tree(training_frame(d, "rid", names, "y"), model.trees)
    return got.select(F.col("row_id").alias("rid"), "tree_id", "leaf", (F.length(F.bin(F.col("leaf") + 1)) - 1).alias("depth"))


@query(o.query(*_CUSTOMERS, *o.unlimited_sql("a", "SELECT rid, 0 AS node, 1 AS m FROM fr"), _LEAF, final="SELECT lf.rid, lf.node // 16 AS leaf, lf.depth, round(p1, 6) AS p1 FROM lf JOIN sh USING (node)", recursive=True))
def tree_unlimited(spark, sf):
    """One tree without a limit of depth."""
    d = customer_frame(spark, sf)
    m = DecisionTree(splitter="hist").fit(d, CS, "y", "rid")
    return _leaves_of(m, d, CS).drop("tree_id").join(m.transform(d.select("rid", *CS)).select("rid", r6(F.col("probability")[1], "p1")), "rid")


@query(o.query(*_CUSTOMERS, *o.unlimited_sql("a", "SELECT rid, 0 AS node, 1 AS m FROM fr", exact=True), _LEAF, final="SELECT lf.rid, lf.node // 16 AS leaf, lf.depth, round(p1, 6) AS p1 FROM lf JOIN sh USING (node)", recursive=True))
def tree_unlimited_exact(spark, sf):
    """The same with a split between any two values."""
    d = customer_frame(spark, sf)
    m = DecisionTree().fit(d, CS, "y", "rid")
    return _leaves_of(m, d, CS).drop("tree_id").join(m.transform(d.select("rid", *CS)).select("rid", r6(F.col("probability")[1], "p1")), "rid")


_BAGGED = "SELECT c.rid, a.tree AS node, coalesce(b.m, 0) AS m FROM cu c CROSS JOIN range(0, 3) a(tree) LEFT JOIN (SELECT tree_id, rank, m FROM bt) b ON b.tree_id = a.tree AND b.rank = c.rank"


@query(o.query(*_CUSTOMERS, _BOOT, *o.unlimited_sql("a", _BAGGED), _LEAF, final="SELECT lf.rid, CAST(lf.tree_id AS INT) AS tree_id, lf.node // 16 AS leaf, lf.depth FROM lf", recursive=True))
def forest_unlimited_leaves(spark, sf):
    """Leaves of bagged trees without a limit of depth, of rows in the bag and out of it."""
    d = customer_frame(spark, sf)
    m = RandomForestClassifier(n_estimators=3, bootstrap="exact", random_state=7).fit(d, CS, "y", "rid")
    return _leaves_of(m, d, CS)


@query("SELECT CAST(t AS INT) AS tree_id, (SELECT count(*) FROM orders) AS drawn, (SELECT count(*) FROM orders) AS in_leaves, true AS kids_sum_to_parents FROM range(0, 100) r(t)")
def forest_unlimited(spark, sf):
    """The default forest: 100 trees without a limit of depth, draws made in the row. Each tree has n draws, all in its leaves, and every split keeps its node's draws."""
    d = orders_frame(spark, sf)
    m = RandomForestClassifier(random_state=4).fit(d, FS, "y", "rid")
    t = m.table(spark)
    kids = t.select("tree_id", F.col("node_id").alias("kid"), F.col("samples").alias("n"))
    inner = t.filter("not is_leaf").select("tree_id", "node_id", "samples", F.explode(F.array("left_id", "right_id")).alias("kid")).join(kids, ["tree_id", "kid"], "left")
    sums = inner.groupBy("tree_id", "node_id").agg(F.first("samples").alias("samples"), F.sum("n").alias("n")).groupBy("tree_id").agg(F.bool_and(F.col("samples") == F.col("n")).alias("ok"))
    root = F.max(F.when(F.col("node_id") == 0, F.col("samples")))
    by_tree = t.groupBy("tree_id").agg(root.alias("drawn"), F.sum(F.when(F.col("is_leaf"), F.col("samples")).otherwise(0)).alias("in_leaves"))
    return by_tree.join(sums, "tree_id", "left").select("tree_id", "drawn", "in_leaves", F.coalesce("ok", F.lit(True)).alias("kids_sum_to_parents"))


@query(f"SELECT o_orderkey AS rid, {o.draw_sql(11, 'o_orderkey')} AS h FROM orders")
def portable_draws(spark, sf):
    return orders_frame(spark, sf).select("rid", draw(11, F.col("rid")).alias("h"))
