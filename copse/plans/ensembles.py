"""Queries of boosting, intervals, early stop, encoding, proximity, attribution and export, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from copse.functions.scalar import draw, softmax, wilson
from copse.operators import boost, early_stop, intervals, leafwise, proximity, shapley, woe
from copse.operators.boost import BoostClassifier, BoostRegressor
from copse.operators.forest import DecisionTree
from copse.operators.proximity import UnsupervisedForest
from copse.plans import oracle as o
from copse.plans.learn import _LEAVES, _MBASE, _ROOT, CODE, CS, FS, r6
from copse.sources import export
from copse.sources.frames import customer_frame, materialised, orders_frame, read_table, training_frame

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- boosting --------------------------------------------------------------

_PRIOR = "pq AS (SELECT least(greatest(avg(y), 1e-5), 1 - 1e-5) AS q FROM fr), pr AS (SELECT ln(q / (1 - q)) AS f, q FROM pq)"


@query(o.query(o.frame_sql("orders"), _PRIOR, final="SELECT rid, round((y - q) / (q * (1 - q)), 6) AS target, round(w * q * (1 - q), 6) AS weight FROM fr, pr"))
def newton_targets(spark, sf):
    d = training_frame(orders_frame(spark, sf), "rid", FS, "y")
    init = boost.binary_prior(d).first()["init"]
    t, w = boost.newton_binary(F.lit(init), F.col("y"), F.col("w"))
    return d.select(F.col("row_id").alias("rid"), r6(t, "target"), r6(w, "weight"))


@query(o.query(o.frame_sql("orders"), _PRIOR, final="SELECT round(sum((y - q) / (q * (1 - q)) * w * q * (1 - q)) / sum(w * q * (1 - q)), 6) AS leaf FROM fr, pr"))
def newton_leaf(spark, sf):
    d = training_frame(orders_frame(spark, sf), "rid", FS, "y")
    t, w = boost.newton_binary(F.lit(boost.binary_prior(d).first()["init"]), F.col("y"), F.col("w"))
    return d.select(t.alias("t"), w.alias("h")).agg(F.round(F.sum(F.col("t") * F.col("h")) / F.sum("h"), 6).alias("leaf"))


@query(f"""WITH d AS (SELECT o_orderkey AS rid, {CODE} AS k FROM orders), s AS (SELECT avg(CAST(k = 0 AS INT)) AS p0, avg(CAST(k = 1 AS INT)) AS p1, avg(CAST(k = 2 AS INT)) AS p2 FROM d)
    SELECT rid, round((CAST(k = 0 AS INT) - p0) / (p0 * (1 - p0)), 6) AS t0, round((CAST(k = 1 AS INT) - p1) / (p1 * (1 - p1)), 6) AS t1, round((CAST(k = 2 AS INT) - p2) / (p2 * (1 - p2)), 6) AS t2 FROM d, s""")
def softmax_targets(spark, sf):
    d = orders_frame(spark, sf).withColumn("k", F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2).cast("double"))
    frame = training_frame(d, "rid", FS, "k")
    init = [r["init"] for r in boost.class_priors(frame).orderBy("label").collect()]
    f = F.array(*[F.lit(v) for v in init])
    return frame.select(F.col("row_id").alias("rid"), *[r6(boost.newton_softmax(f, k, F.col("y"), F.col("w"))[0], f"t{k}") for k in range(3)])


@query("SELECT o_orderkey AS rid, round(exp(a) / (exp(a) + exp(b) + 1), 6) AS p0, round(exp(b) / (exp(a) + exp(b) + 1), 6) AS p1 FROM (SELECT o_orderkey, o_totalprice / 1e5 AS a, month(o_orderdate) / 6 AS b FROM orders)")
def softmax_scores(spark, sf):
    d = orders_frame(spark, sf)
    s = softmax(F.array(F.col("f0") / 1e5, F.col("f2") / 6, F.lit(0.0)))
    return d.select("rid", r6(s[0], "p0"), r6(s[1], "p1"))


# one round, one unbagged stump: variance split on Newton targets
_NEWTON = "fr AS (SELECT rid, f0, f1, f2, f3, y AS y0, (y - q) / (q * (1 - q)) AS y, w * q * (1 - q) AS w FROM fr0, pr)"
_BBASE = (o.frame_sql("orders").replace("fr AS", "fr0 AS", 1), _PRIOR.replace("FROM fr)", "FROM fr0)"), _NEWTON, o.long_sql(4), o.EDGES, o.BINNED, o.hist_sql(o.MOMENTS), o.cand_sql(2, False))


@query(o.query(*_BBASE, final="SELECT bn.rid, round(1 / (1 + exp(-((SELECT f FROM pr) + 0.1 * CASE WHEN bn.bin <= c.bin THEN ls0 / lw ELSE rs0 / rw END))), 6) AS p1 FROM bn JOIN cbest c ON bn.feature = c.feature"))
def boost_round1_binary(spark, sf):
    d = orders_frame(spark, sf)
    m = BoostClassifier(n_estimators=1, rf_n_estimators=1, rf_max_depth=1, bootstrap=False).fit(d, FS, "y", "rid")
    return m.transform(d.select("rid", *FS)).select("rid", r6(F.col("probability")[1], "p1"))


@query(o.query(*_MBASE, o.BINNED, o.hist_sql(["w * (y - (SELECT avg(y) FROM fr))", "w * (y - (SELECT avg(y) FROM fr)) * (y - (SELECT avg(y) FROM fr))"]), o.cand_sql(2, False), final="SELECT bn.rid, round((SELECT avg(y) FROM fr) + 0.1 * CASE WHEN bn.bin <= c.bin THEN ls0 / lw ELSE rs0 / rw END, 6) AS prediction FROM bn JOIN cbest c ON bn.feature = c.feature"))
def boost_residual_round1(spark, sf):
    d = orders_frame(spark, sf).select("rid", "f0", "f1", F.col("f3").alias("g2"), F.col("f2").alias("t"))
    names = ["f0", "f1", "g2"]
    reg = BoostRegressor(n_estimators=1, rf_n_estimators=1, rf_max_depth=1, bootstrap=False)
    frame = training_frame(d, "rid", names, "t")
    m = boost.BoostModel("regression", names, 1, 0.1, [boost.regression_init(frame).first()["init"]])
    reg._rounds(frame, m, [])
    return m.transform(d.select("rid", *names)).select("rid", r6("prediction", "prediction"))


def _boosted(spark, sf, **kw):
    d = orders_frame(spark, sf)
    return d, BoostClassifier(**{"n_estimators": 2, "rf_n_estimators": 4, "rf_max_depth": 3, "bootstrap": "exact", "random_state": 5} | kw).fit(d, FS, "y", "rid")


def _boost_sql(final: str, rounds: int = 2, n_trees: int = 4, depth: int = 3, seed: int = 5, **kw) -> str:
    """Rounds of bagged forests on Newton targets: f<r> has the score after round r."""
    parts = [o.frame_sql("orders"), _PRIOR, o.long_sql(4), o.EDGES, o.BINNED, "f0s AS (SELECT rid, f FROM fr, pr)"]
    for r in range(1, rounds + 1):
        parts.append(f"tg{r} AS (SELECT rid, (y - p) / (p * (1 - p)) AS y, w * p * (1 - p) AS w FROM (SELECT fr.rid, fr.y, fr.w, least(greatest(1 / (1 + exp(-s.f)), 1e-5), 1 - 1e-5) AS p FROM fr JOIN f{r - 1}s s ON s.rid = fr.rid))")
        parts += o.forest_sql("abcdef"[r - 1], seed + 1000 * (r - 1), n_trees, depth, f"tg{r}", **kw)
        parts.append(f"f{r}s AS (SELECT s.rid, s.f + 0.1 * m.v AS f FROM f{r - 1}s s JOIN {'abcdef'[r - 1]}mean m ON m.rid = s.rid)")
    return o.kept(o.query(*parts, final=final))


def _recursive_boost_sql(final: str, rounds: int = 2, n_trees: int = 4, depth: int = 3, seed: int = 5) -> str:
    """The same rows as _boost_sql, each round's trees grown by one recursive step, so that the plan stays short."""
    parts = [o.frame_sql("orders"), _PRIOR, o.long_sql(4), o.EDGES, o.BINNED, "f0s AS (SELECT rid, f FROM fr, pr)"]
    for r in range(1, rounds + 1):
        parts.append(f"tg{r} AS (SELECT rid, (y - p) / (p * (1 - p)) AS y, w * p * (1 - p) AS w FROM (SELECT fr.rid, fr.y, fr.w, least(greatest(1 / (1 + exp(-s.f)), 1e-5), 1 - 1e-5) AS p FROM fr JOIN f{r - 1}s s ON s.rid = fr.rid))")
        parts += o.bagged_mean_sql("abcdef"[r - 1], seed + 1000 * (r - 1), n_trees, depth, f"tg{r}")
        parts.append(f"f{r}s AS (SELECT s.rid, s.f + 0.1 * m.v AS f FROM f{r - 1}s s JOIN {'abcdef'[r - 1]}mean m ON m.rid = s.rid)")
    return o.query(*parts, final=final, recursive=True)


@query(_recursive_boost_sql("SELECT rid, round(1 / (1 + exp(-f)), 6) AS p1, CAST(1 / (1 + exp(-f)) > 0.5 AS INT) AS prediction FROM f2s"))
def boost_predict_proba(spark, sf):
    d, m = _boosted(spark, sf)
    return m.transform(d.select("rid", *FS)).select("rid", r6(F.col("probability")[1], "p1"), "prediction")


@query(_boost_sql("SELECT rid, round(1 / (1 + exp(-f)), 6) AS p1, CAST(1 / (1 + exp(-f)) > 0.5 AS INT) AS prediction FROM f2s", n_trees=2, depth=2))
def boost_two_rounds(spark, sf):
    """Two rounds of two trees of two levels each."""
    d, m = _boosted(spark, sf, rf_n_estimators=2, rf_max_depth=2)
    return m.transform(d.select("rid", *FS)).select("rid", r6(F.col("probability")[1], "p1"), "prediction")


_CLO, _CHI = o.wilson_sql("p", "4.0")


@query(_boost_sql(f"SELECT rid, round({_CLO}, 6) AS ci_low, round({_CHI}, 6) AS ci_high FROM (SELECT rid, 1 / (1 + exp(-f)) AS p FROM f1s)", 1))
def boost_predict_ci(spark, sf):
    d, m = _boosted(spark, sf, n_estimators=1)
    return m.predict_ci(d.select("rid", *FS)).select("rid", r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


def _softmax_sql() -> str:
    """One round of three outputs, each on the scores that the earlier ones left."""
    priors = ", ".join(f"ln(least(greatest(avg(CAST(k = {k} AS INT)), 1e-5), 1 - 1e-5)) AS i{k}" for k in range(3))
    parts = [o.frame_sql("orders"), f"kd AS (SELECT o_orderkey AS rid, {CODE} AS k FROM orders)", o.long_sql(4), o.EDGES, o.BINNED, f"pr AS (SELECT {priors} FROM kd)", "g0 AS (SELECT rid, k, i0, i1, i2 FROM kd, pr)"]
    for k in range(3):
        p = f"least(greatest(exp(i{k}) / (exp(i0) + exp(i1) + exp(i2)), 1e-5), 1 - 1e-5)"
        parts.append(f"tg{k} AS (SELECT rid, (CAST(k = {k} AS INT) - p) / (p * (1 - p)) AS y, p * (1 - p) AS w FROM (SELECT rid, k, {p} AS p FROM g{k}))")
        parts += o.forest_sql("abc"[k], 1 + k, 3, 2, f"tg{k}")
        parts.append(f"g{k + 1} AS (SELECT g.* REPLACE (g.i{k} + 0.1 * m.v AS i{k}) FROM g{k} g JOIN {'abc'[k]}mean m ON m.rid = g.rid)")
    shares = ", ".join(f"round(exp(i{k}) / (exp(i0) + exp(i1) + exp(i2)), 6) AS p{k}" for k in range(3))
    return o.kept(o.query(*parts, final=f"SELECT rid, {shares}, CASE WHEN i2 >= i0 AND i2 >= i1 THEN 2 WHEN i1 >= i0 THEN 1 ELSE 0 END AS prediction FROM g3"))


@query(_softmax_sql())
def boost_multiclass(spark, sf):
    d = orders_frame(spark, sf).withColumn("k", F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2))
    m = BoostClassifier(n_estimators=1, rf_n_estimators=3, rf_max_depth=2, bootstrap="exact", random_state=1).fit(d, FS, "k", "rid")
    return m.transform(d.select("rid", *FS)).select("rid", *[r6(F.col("probability")[k], f"p{k}") for k in range(3)], "prediction")


@query()
def boost_early_stop(spark, sf):
    d, m = _boosted(spark, sf, n_estimators=1, rf_n_estimators=12, async_mode=True, tol=0.05)
    return spark.createDataFrame([(r, n) for r, n in enumerate(m.trees_used)], "round int, trees_used int")


@query(_boost_sql("SELECT CAST(t.f AS INT) AS feature, round(coalesce(s.n, 0) / (SELECT sum(samples) FROM asp), 6) AS importance FROM range(0, 4) t(f) LEFT JOIN (SELECT feature, sum(samples) AS n FROM asp GROUP BY feature) s ON s.feature = t.f", 1))
def boost_importances(spark, sf):
    _, m = _boosted(spark, sf, n_estimators=1)
    own = spark.createDataFrame(list(enumerate(m.feature_importances())), "feature int, importance double")
    return own.select("feature", (F.round(F.col("importance") * 1e6) / 1e6).alias("importance"))  # halves go up, as in SQL; Python's round takes some down


@query(_boost_sql("SELECT rid, round(1 / (1 + exp(-f)), 6) AS p1 FROM f1s", 1, boot=False, rising=0))
def boost_monotone(spark, sf):
    d, m = _boosted(spark, sf, n_estimators=1, bootstrap=False, monotone_constraints={"f0": 1})
    return m.transform(d.select("rid", *FS)).select("rid", r6(F.col("probability")[1], "p1"))


# --- intervals -------------------------------------------------------------

_WLO, _WHI = o.wilson_sql("p", "n")


@query(f"WITH s AS (SELECT c_nationkey AS k, avg(CAST(c_custkey % 3 = 0 AS INT)) AS p, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) SELECT k, round({_WLO}, 6) AS lo, round({_WHI}, 6) AS hi FROM s")
def wilson_ci(spark, sf):
    s = customer_frame(spark, sf).groupBy(F.col("f0").cast("int").alias("k")).agg(F.avg("y").alias("p"), F.count("*").cast("double").alias("n"))
    lo, hi = wilson(F.col("p"), F.col("n"))
    return s.select("k", r6(lo, "lo"), r6(hi, "hi"))


_SPLIT = f"sp AS (SELECT c_custkey AS rid, c_acctbal AS v, row_number() OVER (ORDER BY {o.draw_sql(9, chr(39) + 'split' + chr(39), 'c_custkey')}, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer), ct AS (SELECT rid, v, r >= n - CAST(floor(n * 0.2) AS BIGINT) AS is_calibration FROM sp)"


def _calibration(spark, sf):
    f = training_frame(customer_frame(spark, sf), "rid", CS, "f1")
    return intervals.conformal_split(f, 0.2, 9)


@query(o.query(_SPLIT, final="SELECT rid, is_calibration FROM ct"))
def conformal_split(spark, sf):
    return _calibration(spark, sf).select(F.col("row_id").alias("rid"), "is_calibration")


_QUANT = """tm AS (SELECT avg(v) AS m FROM ct WHERE NOT is_calibration), rs AS (SELECT abs(v - m) AS r FROM ct, tm WHERE is_calibration),
    ro AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM rs), cq AS (SELECT max(r) AS q FROM ro WHERE k = least(CAST(ceil(0.95 * (1 + 1.0::DOUBLE / n) * n) AS BIGINT), n - 1))"""


def _quantile(spark, sf):
    d = materialised(_calibration(spark, sf), "calibration")
    mean = d.filter("not is_calibration").agg(F.avg("y")).first()[0]
    return d, mean, intervals.conformal_quantile(d.filter("is_calibration").select((F.col("y") - F.lit(mean)).alias("residual")))


@query(o.query(_SPLIT, _QUANT, final="SELECT round(q, 6) AS q FROM cq"))
def conformal_quantile(spark, sf):
    return _quantile(spark, sf)[2].select(r6("q", "q"))


@query(o.query(_SPLIT, _QUANT, final="SELECT rid, round(m - q, 6) AS ci_low, round(m + q, 6) AS ci_high FROM ct, tm, cq"))
def conformal_ci(spark, sf):
    d, mean, q = _quantile(spark, sf)
    v = q.first()["q"]
    return d.select(F.col("row_id").alias("rid"), r6(F.lit(mean - v), "ci_low"), r6(F.lit(mean + v), "ci_high"))


def _interval_sql() -> str:
    """A fit on the rows that don't calibrate, the quantile of the others' residuals, and a fit on all rows."""
    draws = o.draw_sql(2, "'split'", "rid")
    cut = f"ct AS (SELECT *, row_number() OVER (ORDER BY {draws}, rid) - 1 >= count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS apart FROM fr)"

    def fit(p: str, rows: str, beside: str | None) -> str:
        frame = f"ff AS (SELECT * FROM {rows})"
        binned = o.BINNED.replace("FROM lg ", "FROM la ").replace("lg.", "la.")
        steps = [frame, o.long_sql(2, "ff"), o.EDGES, o.long_sql(2, "fr").replace("lg AS", "la AS", 1), binned, "iv AS (SELECT avg(y) AS f FROM ff)", "tg AS (SELECT rid, y - f AS y, w FROM ff, iv)"]
        steps += o.forest_sql(p, 2, 3, 3, "tg", beside=beside)
        return "WITH " + ", ".join(steps) + f" SELECT m.rid, iv.f + 0.1 * m.v AS f FROM {p}mean m, iv"

    parts = [o.frame_sql("customer").replace("fr AS", "fr0 AS", 1), "fr AS (SELECT rid, f0, f2 AS f1, f1 AS y, w FROM fr0)", cut, "tr AS (SELECT rid, f0, f1, y, w FROM ct WHERE NOT apart)", "ca AS (SELECT rid, y FROM ct WHERE apart)"]
    parts += [f"m1 AS ({fit('a', 'tr', 'ca')})", "rs AS (SELECT abs(ca.y - m1.f) AS r FROM ca JOIN m1 ON m1.rid = ca.rid)", "ro AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM rs)"]
    parts += ["cq AS (SELECT max(r) AS q FROM ro WHERE k = least(CAST(ceil(0.95 * (1 + 1.0::DOUBLE / n) * n) AS BIGINT), n - 1))", f"m2 AS ({fit('b', 'fr', None)})"]
    return o.kept(o.query(*parts, final="SELECT rid, round(f, 6) AS prediction, round(f - q, 6) AS ci_low, round(f + q, 6) AS ci_high FROM m2, cq"))


@query(_interval_sql())
def boost_regression_ci(spark, sf):
    d = customer_frame(spark, sf)
    m = BoostRegressor(n_estimators=1, rf_n_estimators=3, rf_max_depth=3, bootstrap="exact", random_state=2).fit(d, ["f0", "f2"], "f1", "rid")
    return m.predict_ci(d.select("rid", "f0", "f2")).select("rid", r6("prediction", "prediction"), r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


# --- early stop, on a fixed table of tree predictions ----------------------

_PREDS = f"tp AS (SELECT c_custkey AS row_id, CAST(t AS INT) AS tree_id, CAST(({o.draw_sql(5, 'c_custkey', 't')} + 3 * (c_custkey % 2) * 1000000000) % 7 < 5 AS INT)::DOUBLE AS value FROM customer, range(0, 12) a(t))"


def _preds(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tree_id"))
    v = (draw(5, F.col("row_id"), F.col("tree_id")) + 3 * (F.col("row_id") % 2) * 1000000000) % 7 < 5
    return c.withColumn("value", v.cast("double"))


_V1, _V2 = o.wilson_sql("p1", "c")[0], o.wilson_sql("p2", "c")[1]
_VOTES = """rv AS (SELECT row_id, tree_id, count(*) OVER w AS c, avg(value) OVER w AS s1 FROM tp WINDOW w AS (PARTITION BY row_id ORDER BY tree_id ROWS UNBOUNDED PRECEDING)),
    r2 AS (SELECT row_id, c, greatest(s1, 1 - s1) AS p1, least(s1, 1 - s1) AS p2 FROM rv)"""


@query(o.query(_PREDS, _VOTES, final=f"SELECT c, round(avg(CAST({_V1} > {_V2} AS INT)), 6) AS stable FROM r2 GROUP BY c"))
def early_stop_votes(spark, sf):
    return early_stop.stability_votes(_preds(spark, sf), 2).select("c", r6("stable", "stable"))


_MOM = """rm AS (SELECT row_id, value, count(*) OVER w AS c, avg(value) OVER w AS mean, var_samp(value) OVER w AS var FROM tp WINDOW w AS (PARTITION BY row_id ORDER BY tree_id ROWS UNBOUNDED PRECEDING)),
    sd AS (SELECT c, greatest(max(mean) - min(mean), 1e-10) AS spread FROM rm GROUP BY c)"""


@query(o.query(_PREDS, _MOM, final="""SELECT c, round(avg(CAST(1.96 * sqrt(coalesce(var, 0) / c) < 0.05 * spread AS INT)), 6) AS stable,
    round(max(CASE WHEN c > 1 THEN abs(value - (mean * c - value) / (c - 1)) / c END), 6) AS max_change FROM rm JOIN sd USING (c) GROUP BY c"""))
def early_stop_regression(spark, sf):
    return early_stop.stability_regression(_preds(spark, sf)).select("c", r6("stable", "stable"), r6("max_change", "max_change"))


_UP, _UQ = o.wilson_sql("pp", "c")


@query(o.query(_PREDS, _MOM, "up AS (SELECT *, least(greatest(1 / (1 + exp(-mean)), 1e-6), 1 - 1e-6) AS pp FROM rm)", final=f"SELECT c, round(avg(CAST({_UQ} < 0.5 OR {_UP} > 0.5 AS INT)), 6) AS stable FROM up GROUP BY c"))
def early_stop_updates(spark, sf):
    return early_stop.stability_updates(_preds(spark, sf)).select("c", r6("stable", "stable"))


@query(o.query(_PREDS, _VOTES, f"st AS (SELECT c, avg(CAST({_V1} > {_V2} AS INT)) AS stable FROM r2 GROUP BY c)", final="SELECT min(c) AS trees_used FROM st WHERE c >= 3 AND stable >= 0.9"))
def early_stop_first(spark, sf):
    return early_stop.first_stable(early_stop.stability_votes(_preds(spark, sf), 2), 3)


# --- weight of evidence ----------------------------------------------------

_WOE = """wt AS (SELECT feature, category, sum(p) AS pos, count(*) - sum(p) AS neg FROM wl GROUP BY ALL),
    wo AS (SELECT feature, category, pos, neg, ln(((pos + 0.5) / (sum(pos) OVER f + 0.5 * count(*) OVER f)) / ((neg + 0.5) / (sum(neg) OVER f + 0.5 * count(*) OVER f))) AS woe FROM wt WINDOW f AS (PARTITION BY feature))"""
_WL = "wl AS (SELECT 0 AS feature, c_mktsegment AS category, CAST(c_custkey % 3 = 0 AS INT) AS p FROM customer UNION ALL SELECT 1, CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 3 = 0 AS INT) FROM customer)"


def _customers(spark, sf):
    return read_table(spark, sf, "customer").withColumn("y", (F.col("c_custkey") % 3 == 0).cast("int"))


CATS = ["c_mktsegment", "c_nationkey"]


@query(o.query(_WL, _WOE, final="SELECT feature, category, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(woe, 6) AS woe FROM wo"))
def woe_binary(spark, sf):
    t = woe.WoeEncoder(CATS).fit(_customers(spark, sf), [*CATS, "c_acctbal"], "y").tables[0]
    return t.select("feature", "category", "pos", "neg", r6("woe", "woe"))


@query(o.query(_WL, _WOE, final="SELECT feature, round(sum((pos / spos - neg / sneg) * woe), 6) AS iv FROM (SELECT *, sum(pos) OVER (PARTITION BY feature) AS spos, sum(neg) OVER (PARTITION BY feature) AS sneg FROM wo) GROUP BY feature"))
def woe_iv(spark, sf):
    enc = woe.WoeEncoder(CATS)
    return enc.iv(enc.fit(_customers(spark, sf), CATS, "y")).select("feature", r6("iv", "iv"))


@query(o.query(_WL, _WOE, final="SELECT c.c_custkey AS rid, round(a.woe, 6) AS woe_c_mktsegment, round(b.woe, 6) AS woe_c_nationkey, c.c_acctbal FROM customer c JOIN wo a ON a.feature = 0 AND a.category = c.c_mktsegment JOIN wo b ON b.feature = 1 AND b.category = CAST(c.c_nationkey AS VARCHAR)"))
def woe_transform(spark, sf):
    d = _customers(spark, sf)
    out = woe.WoeEncoder(CATS).fit(d, [*CATS, "c_acctbal"], "y").transform(d, ["c_custkey"])
    return out.select(F.col("c_custkey").alias("rid"), *[r6(f"woe_{c}", f"woe_{c}") for c in CATS], "c_acctbal")


@query(o.query("wl AS (SELECT k AS output, 0 AS feature, o_orderpriority AS category, CAST(kk = k AS INT) AS p FROM (SELECT o_orderpriority, " + CODE + " AS kk FROM orders), range(0, 3) t(k))",
    """wt AS (SELECT output, feature, category, sum(p) AS pos, count(*) - sum(p) AS neg FROM wl GROUP BY ALL),
    wo AS (SELECT *, ln(((pos + 0.5) / (sum(pos) OVER f + 0.5 * count(*) OVER f)) / ((neg + 0.5) / (sum(neg) OVER f + 0.5 * count(*) OVER f))) AS woe FROM wt WINDOW f AS (PARTITION BY output, feature))""",
    final="SELECT CAST(output AS INT) AS output, category, round(woe, 6) AS woe FROM wo"))
def woe_multiclass(spark, sf):
    d = read_table(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    m = woe.WoeEncoder(["o_orderpriority"]).fit(d, ["o_orderpriority"], "k", "multiclass")
    out = None
    for k, t in enumerate(m.tables):
        own = t.select(F.lit(k).alias("output"), "category", r6("woe", "woe"))
        out = own if out is None else out.unionByName(own)
    return out


@query(o.query("wl AS (SELECT k AS output, 0 AS feature, o_orderpriority AS category, CAST(kk = k AS INT) AS p FROM (SELECT o_orderpriority, " + CODE + " AS kk FROM orders), range(0, 3) t(k))",
    """wt AS (SELECT output, feature, category, sum(p) AS pos, count(*) - sum(p) AS neg FROM wl GROUP BY ALL),
    wo AS (SELECT *, ln(((pos + 0.5) / (sum(pos) OVER f + 0.5 * count(*) OVER f)) / ((neg + 0.5) / (sum(neg) OVER f + 0.5 * count(*) OVER f))) AS woe FROM wt WINDOW f AS (PARTITION BY output, feature))""",
    final="SELECT t.o_orderkey AS rid, round(a.woe, 6) AS woe_o_orderpriority_0, round(b.woe, 6) AS woe_o_orderpriority_1, round(c.woe, 6) AS woe_o_orderpriority_2, t.o_totalprice FROM orders t JOIN wo a ON a.output = 0 AND a.category = t.o_orderpriority JOIN wo b ON b.output = 1 AND b.category = t.o_orderpriority JOIN wo c ON c.output = 2 AND c.category = t.o_orderpriority"))
def woe_multiclass_transform(spark, sf):
    """The task is told from the target's three values."""
    d = read_table(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    out = woe.WoeEncoder(["o_orderpriority"]).fit(d, ["o_orderpriority", "o_totalprice"], "k").transform(d, ["o_orderkey"])
    return out.select(F.col("o_orderkey").alias("rid"), *[r6(f"woe_o_orderpriority_{k}", f"woe_o_orderpriority_{k}") for k in range(3)], "o_totalprice")


@query(o.query("wl AS (SELECT 0 AS feature, c_mktsegment AS category, CAST(c_acctbal > (SELECT median(c_acctbal) FROM customer) AS INT) AS p FROM customer)", _WOE, final="SELECT category, round(woe, 6) AS woe FROM wo"))
def woe_continuous(spark, sf):
    t = woe.WoeEncoder(["c_mktsegment"]).fit(_customers(spark, sf), ["c_mktsegment"], "c_acctbal", "continuous").tables[0]
    return t.select("category", r6("woe", "woe"))


@query("SELECT d.lang AS category, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS pos FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def woe_counts_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang").join(read_table(spark, sf, "labels"), "doc_id")
    t = woe.woe_table(d, ["lang"], F.col("quality") == 1)
    return t.select("category", (F.col("pos") + F.col("neg")).alias("n"), "pos")


# --- unsupervised forest ---------------------------------------------------

_PERM = f"""pt AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part),
    pa AS (SELECT a, row_number() OVER (ORDER BY {o.draw_sql(4, "'perm'", '0', 'id')}, id) - 1 AS r FROM pt), pb AS (SELECT b, row_number() OVER (ORDER BY {o.draw_sql(4, "'perm'", '1', 'id')}, id) - 1 AS r FROM pt)"""


@query(o.query(_PERM, final="SELECT id AS row_id, 1.0::DOUBLE AS y, a AS p_size, b AS p_retailprice FROM pt UNION ALL SELECT r + (SELECT max(id) FROM pt) + 1, 0.0, a, b FROM pa JOIN pb USING (r)"))
def synthetic_union(spark, sf):
    return proximity.synthetic_union(read_table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], 4)


# leaves of three fixed stumps over the first dimensions of the embeddings; the bag is a hash of (row, tree)
_LV = f"""lv AS (SELECT vec_id AS row_id, CAST(t AS INT) AS tree_id, CASE WHEN embedding[t + 1] <= 0 THEN 1 ELSE 2 END * 3 + CASE WHEN embedding[t + 4] <= 0.05 THEN 0 ELSE 1 END AS leaf FROM embeddings, range(0, 3) a(t)),
    bg AS (SELECT row_id, tree_id FROM lv WHERE {o.draw_sql(6, 'row_id', 'tree_id')} % 3 < 2), bothbag AS (SELECT a.row_id AS i, b.row_id AS j, count(*) AS n_both FROM bg a JOIN bg b USING (tree_id) GROUP BY ALL)"""
_PX = """px AS (SELECT a.row_id AS i, b.row_id AS j, count(*) / 3.0::DOUBLE AS prox FROM lv a JOIN lv b USING (tree_id, leaf) GROUP BY ALL)"""


def _fixed_leaves(spark, sf):
    e = read_table(spark, sf, "embeddings")
    t = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree_id")
    d = e.select(F.col("vec_id").alias("row_id"), "embedding", t)
    leaf = F.when(F.element_at("embedding", F.col("tree_id") + 1) <= 0, 1).otherwise(2) * 3 + F.when(F.element_at("embedding", F.col("tree_id") + 4) <= F.lit(0.05), 0).otherwise(1)
    lv = materialised(d.select("row_id", "tree_id", leaf.alias("leaf")), "leaves")
    return lv, lv.filter(draw(6, F.col("row_id"), F.col("tree_id")) % 3 < 2).select("row_id", "tree_id")


@query(o.query(_LV, """sm AS (SELECT a.row_id AS i, b.row_id AS j, sum(CASE WHEN x.row_id IS NULL OR z.row_id IS NULL THEN 1 ELSE 0 END) AS same FROM lv a JOIN lv b USING (tree_id, leaf)
    LEFT JOIN bg x ON x.row_id = a.row_id AND x.tree_id = a.tree_id LEFT JOIN bg z ON z.row_id = b.row_id AND z.tree_id = b.tree_id GROUP BY ALL)""",
    final="SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE same / (3.0 - coalesce(n_both, 0)) END, 6) AS prox FROM sm LEFT JOIN bothbag USING (i, j) WHERE same > 0"))
def proximity_oob(spark, sf):
    lv, bag = _fixed_leaves(spark, sf)
    pairs, members = proximity.class_pairs(lv, bag)
    return proximity.expanded(pairs.select("i", "j", r6("prox", "prox")), members)  # a pair of rows has the proximity of its classes


@query(o.query(_LV, _PX, final="SELECT i, j, round(prox, 6) AS prox, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY prox DESC, j) AS r FROM px WHERE i <> j) WHERE r <= 5"))
def proximity_topk(spark, sf):
    return leafwise.nearest(_fixed_leaves(spark, sf)[0], 5).select("i", "j", r6("prox", "prox"), "rank")


@query(o.query(_LV, final="SELECT a.row_id AS i, b.row_id AS j, round(count(*) / 3.0, 6) AS prox FROM lv a JOIN lv b USING (tree_id, leaf) WHERE a.row_id >= 400 AND b.row_id < 400 GROUP BY ALL"))
def proximity_new(spark, sf):
    lv, _ = _fixed_leaves(spark, sf)
    return proximity.co_leaf(lv.filter("row_id >= 400"), lv.filter("row_id < 400")).groupBy("i", "j").agg(r6(F.count("*") / 3.0, "prox"))


_OUT = """ra AS (SELECT i, 500.0 / sum(prox * prox) AS raw FROM px GROUP BY i), rr AS (SELECT *, row_number() OVER (ORDER BY raw) - 1 AS k, count(*) OVER () AS m FROM ra),
    md AS (SELECT max(raw) AS med FROM rr WHERE k = m // 2), ma AS (SELECT med, CASE WHEN avg(least(abs(raw - med), 5 * med)) > 0 THEN avg(least(abs(raw - med), 5 * med)) ELSE 1 END AS mad FROM ra, md GROUP BY med)"""


@query(o.query(_LV, _PX, _OUT, final="SELECT i AS row_id, round(least((raw - med) / mad, 20.0), 6) AS score FROM ra, ma"))
def outlier_scores(spark, sf):
    lv, _ = _fixed_leaves(spark, sf)
    return proximity.outlier_scores(proximity.squares(lv), 500).select("row_id", r6("score", "score"))


@query(o.query(_LV, "pn AS (SELECT a.row_id AS i, b.row_id AS j, count(*) / 3.0 AS prox FROM lv a JOIN lv b USING (tree_id, leaf) WHERE a.row_id >= 400 AND b.row_id < 400 GROUP BY ALL)", final="SELECT n.row_id, round(coalesce(least(400.0 / sum(prox * prox), 20.0), 20.0), 6) AS score FROM (SELECT DISTINCT row_id FROM lv WHERE row_id >= 400) n LEFT JOIN pn ON i = n.row_id GROUP BY n.row_id"))
def outlier_new(spark, sf):
    lv, _ = _fixed_leaves(spark, sf)
    return proximity.outlier_new(proximity.squares(lv.filter("row_id >= 400"), lv.filter("row_id < 400")), 400).select("row_id", r6("score", "score"))


def _unsupervised(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)])
    return UnsupervisedForest(n_estimators=6, max_depth=4, random_state=3).fit(e, [f"e{k}" for k in range(4)], "id")


@query()
def unsupervised_outliers(spark, sf):
    return _unsupervised(spark, sf).outlier_scores()


@query()
def mds_embedding(spark, sf):
    lv, _ = _fixed_leaves(spark, sf)
    return leafwise.scaling(lv, 2)


@query()
def unsup_importance(spark, sf):
    return spark.createDataFrame([(i, v) for i, v in enumerate(_unsupervised(spark, sf).feature_importances())], "feature int, importance double")


# --- attribution, export, streaming ----------------------------------------

_SHAP = (*_ROOT, _LEAVES)


@query(o.query(*_SHAP, "pv AS (SELECT b.feature, nd.rid, CASE WHEN nd.node = 1 THEN ls1 / lw ELSE rs1 / rw END AS v, ts1 / tw AS base FROM nd, cbest b)", final="SELECT pv.rid, CAST(f AS INT) AS feature, round(CASE WHEN f = pv.feature THEN v - base ELSE 0.0 END, 6) AS phi FROM pv, range(0, 4) t(f)"))
def tree_shap_stump(spark, sf):
    d = orders_frame(spark, sf)
    m = DecisionTree(max_depth=1, splitter="hist").fit(d, FS, "y", "rid")
    frame = training_frame(d, "rid", FS, "y")
    return shapley.explain(frame, m.trees, frame).filter("output = 1").select(F.col("row_id").alias("rid"), "feature", r6("phi", "phi"))


@query(o.query(*_SHAP, """bn1 AS (SELECT bn.*, nd.node FROM bn JOIN nd USING (rid))""", o.hist_sql(o.GINI2, "bn1", group="node", name="h1"), o.cand_sql(2, True, name="d", hist="h1"),
    """lf AS (SELECT r.rid, r.y, CASE WHEN d.feature IS NULL THEN r.node WHEN b.bin <= d.bin THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS leaf FROM nd r LEFT JOIN dbest d ON d.node = r.node LEFT JOIN bn b ON b.rid = r.rid AND b.feature = d.feature),
    pr AS (SELECT leaf, avg(y) AS p FROM lf GROUP BY leaf)""", final="SELECT rid, round(p - (SELECT avg(y) FROM fr), 6) AS total FROM lf JOIN pr USING (leaf)"))  # fmt: skip
def tree_shap_depth2(spark, sf):
    """Efficiency: attributions of class 1 add up to the prediction less the base value."""
    d = orders_frame(spark, sf)
    m = DecisionTree(max_depth=2, splitter="hist").fit(d, FS, "y", "rid")
    frame = training_frame(d, "rid", FS, "y")
    return shapley.explain(frame, m.trees, frame).filter("output = 1").groupBy(F.col("row_id").alias("rid")).agg(r6(F.sum("phi"), "total"))


@query()
def export_model(spark, sf):
    _, m = _boosted(spark, sf, n_estimators=1)
    return export.nested_trees(m.table(spark))


_PREORDER = o.kept(", pre AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS at FROM (SELECT *, CAST(node // 1000 AS INT) AS tree_id, node % 1000 AS node_id, substr(bin(node % 1000 + 1), 2) AS path FROM anodes)) ")


@query(_boost_sql("", 1).rstrip() + _PREORDER + """SELECT t.tree_id, string_agg(CAST(coalesce(l.at, -1) AS VARCHAR), ',' ORDER BY t.at) AS children_left, string_agg(CAST(coalesce(r.at, -1) AS VARCHAR), ',' ORDER BY t.at) AS children_right,
    string_agg(CAST(t.feature AS VARCHAR), ',' ORDER BY t.at) AS feature, round(sum(e.edge), 4) AS thresholds, round(sum(v.v), 4) AS leaf_values
    FROM pre t LEFT JOIN pre l ON l.tree_id = t.tree_id AND l.node_id = 2 * t.node_id + 1 LEFT JOIN pre r ON r.tree_id = t.tree_id AND r.node_id = 2 * t.node_id + 2
    LEFT JOIN ed e ON e.feature = t.feature AND e.bin = t.bin LEFT JOIN alv v ON t.is_leaf AND v.node = t.node GROUP BY t.tree_id""")
def export_arrays(spark, sf):
    """The nested export, a row for each tree: its index arrays as text, sums of its thresholds and leaf values."""
    _, m = _boosted(spark, sf, n_estimators=1)
    trees = export.nested_trees(m.table(spark)).select(F.posexplode(F.col("rounds")[0]["outputs"][0]["trees"]).alias("tree_id", "t"))
    text = lambda c: F.array_join(F.transform(F.col("t")[c], lambda v: v.cast("string")), ",").alias(c)
    leaf = F.transform("t.feature", lambda f: f == -1)
    add = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 4)
    kept = F.filter("t.threshold", lambda v: ~F.isnan(v))
    own = F.zip_with("t.value", leaf, lambda v, is_leaf: F.when(is_leaf, v).otherwise(0.0))
    return trees.select("tree_id", text("children_left"), text("children_right"), text("feature"), add(kept).alias("thresholds"), add(own).alias("leaf_values"))


# preorder is the order of root-to-node paths: a node's path is the binary digits of its heap id + 1 after the first
_PRE = """SELECT CAST(0 AS INT) AS round, CAST(0 AS INT) AS output, t.tree_id, t.node_id, t.at, l.at AS left_at, r.at AS right_at
    FROM pre t LEFT JOIN pre l ON l.tree_id = t.tree_id AND l.node_id = 2 * t.node_id + 1 LEFT JOIN pre r ON r.tree_id = t.tree_id AND r.node_id = 2 * t.node_id + 2"""


@query(_boost_sql("", 1).rstrip() + o.kept(", pre AS (SELECT tree_id, node_id, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS at FROM (SELECT CAST(node // 1000 AS INT) AS tree_id, node % 1000 AS node_id, substr(bin(node % 1000 + 1), 2) AS path FROM anodes)) ") + _PRE)
def export_preorder(spark, sf):
    _, m = _boosted(spark, sf, n_estimators=1)
    return export.preorder(m.table(spark)).select("round", "output", "tree_id", "node_id", "at", "left_at", "right_at")
