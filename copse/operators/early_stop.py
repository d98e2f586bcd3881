"""Early stop: grow trees in fixed batches and stop at the first prefix of trees that is stable.

The rules are running votes, or running mean and variance, by tree order: as
window queries over a table (row_id, tree_id, value), and, while trees grow, as
``row_report`` inside the pass that scores the rows, which returns sums for each
number of trees and shuffles no row. Between batches of trees each row keeps its
votes, or its sum and sum of squares, so a batch scores its own trees only.
Growing in fixed batches makes the result the same every time.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.scalar import sigmoid, wilson
from copse.operators.binning import matrix
from copse.operators.grow import Trees, descend, grow
from copse.operators.score import blocks_of, sent
from copse.sources.frames import dropped, materialised

SHARE, Z = 0.90, 1.96
#: Values (rows x trees x classes) that a task holds at a time.
CELLS = 2_000_000


def running_votes(preds: DataFrame, n_classes: int) -> DataFrame:
    """(row_id, c, p1, p2): top two vote shares after each number of trees."""
    upto = Window.partitionBy("row_id").orderBy("tree_id").rowsBetween(Window.unboundedPreceding, 0)
    c = F.count("*").over(upto)
    shares = F.array(*[F.sum((F.col("value") == k).cast("double")).over(upto) / c for k in range(n_classes)])
    v = preds.select("row_id", c.alias("c"), F.sort_array(F.concat(shares, F.array(F.lit(0.0), F.lit(0.0))), asc=False).alias("s"))
    return v.select("row_id", "c", F.col("s")[0].alias("p1"), F.col("s")[1].alias("p2"))


def running_moments(preds: DataFrame) -> DataFrame:
    """(row_id, c, value, mean, var) after each number of trees."""
    upto = Window.partitionBy("row_id").orderBy("tree_id").rowsBetween(Window.unboundedPreceding, 0)
    return preds.select("row_id", F.count("*").over(upto).alias("c"), "value", F.avg("value").over(upto).alias("mean"), F.var_samp("value").over(upto).alias("var"))


def stability_votes(preds: DataFrame, n_classes: int) -> DataFrame:
    """(c, stable): share of rows whose first class is ahead of the second beyond both intervals."""
    v = running_votes(preds, n_classes)
    lo1, hi2 = wilson(F.col("p1"), F.col("c"), Z)[0], wilson(F.col("p2"), F.col("c"), Z)[1]
    return v.groupBy("c").agg(F.avg((lo1 > hi2).cast("double")).alias("stable"))


def stability_regression(preds: DataFrame) -> DataFrame:
    """(c, stable, max_change): interval half-width under 5 % of the spread of means; largest change of a mean."""
    m = running_moments(preds)
    spread = m.groupBy("c").agg(F.greatest(F.max("mean") - F.min("mean"), F.lit(1e-10)).alias("spread"))
    m = m.join(spread, "c")
    prev = (F.col("mean") * F.col("c") - F.col("value")) / (F.col("c") - 1)
    change = F.when(F.col("c") > 1, F.abs(F.col("value") - prev) / F.col("c"))
    half = Z * F.sqrt(F.coalesce("var", F.lit(0.0)) / F.col("c"))
    return m.groupBy("c").agg(F.avg((half < 0.05 * F.col("spread")).cast("double")).alias("stable"), F.max(change).alias("max_change"))


def stability_updates(preds: DataFrame) -> DataFrame:
    """(c, stable, max_change) of a boosting round: intervals on the sigmoid of the mean update that leave out one half."""
    m = running_moments(preds)
    p = F.greatest(F.least(sigmoid(F.col("mean")), F.lit(1 - 1e-6)), F.lit(1e-6))
    lo, hi = wilson(p, F.col("c"), Z)
    prev = (F.col("mean") * F.col("c") - F.col("value")) / (F.col("c") - 1)
    change = F.when(F.col("c") > 1, F.abs(F.col("value") - prev) / F.col("c"))
    return m.groupBy("c").agg(F.avg(((hi < 0.5) | (lo > 0.5)).cast("double")).alias("stable"), F.max(change).alias("max_change"))


def first_stable(report: DataFrame, min_trees: int, tol: float = 0.0) -> DataFrame:
    """One row: the first number of trees at which the rule holds (null if none)."""
    ok = F.col("max_change") < tol if tol > 0 and "max_change" in report.columns else F.col("stable") >= SHARE
    return report.filter((F.col("c") >= min_trees) & (F.col("c") > 1) & ok).agg(F.min("c").alias("trees_used"))


def _interval(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wilson interval of shares p over n, clipped to [0, 1]."""
    centre, scale = p + Z * Z / (2 * n), 1 + Z * Z / n
    half = Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return np.maximum((centre - half) / scale, 0.0), np.minimum((centre + half) / scale, 1.0)


def _running(v: np.ndarray, state: np.ndarray | None = None, seen: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sample variance and change of the mean after each column of v (rows x trees), beyond the seen trees of state."""
    c = seen + np.arange(1, v.shape[1] + 1)
    first = v[:, :1] if state is None else state[:, :1]
    s1, s2 = (0.0, 0.0) if state is None else (state[:, 1:2], state[:, 2:3])
    off = v - first  # so that squares lose no digits
    s1, s2 = s1 + np.cumsum(off, axis=1), s2 + np.cumsum(off * off, axis=1)
    mean = s1 / c
    var = np.maximum(s2 - c * mean * mean, 0.0) / np.maximum(c - 1, 1)
    before = np.concatenate([np.zeros((len(v), 1)) if state is None else state[:, 1:2] / max(seen, 1), mean[:, :-1]], axis=1)
    change = np.abs(off - before) / c
    return mean + first, var, change


def _merged(v: np.ndarray, state: np.ndarray | None, n_classes: int | None) -> np.ndarray:
    """The state of each row with the values v added: votes by class, or (first value, sum and sum of squares of distances from it)."""
    if n_classes:
        votes = (v[:, :, None] == np.arange(n_classes)).sum(axis=1).astype(float)
        return votes if state is None else state + votes
    first = v[:, :1] if state is None else state[:, :1]
    off = v - first
    sums = np.stack([off.sum(axis=1), (off * off).sum(axis=1)], axis=1)
    return np.concatenate([first, sums if state is None else state[:, 1:] + sums], axis=1)


class Scoring:
    """Values of trees for rows with features x, or their bins b, and with the state that earlier trees have left, if any."""

    def __init__(self, data: DataFrame, trees: Trees):
        self.model, self.ids = sent(data.sparkSession, trees), trees.tree_ids
        self.features, self.cut = ("x", "threshold") if "x" in data.columns else ("b", "bin")
        self.has_state = "state" in data.columns
        self.columns = [self.features, *(["state"] if self.has_state else [])]
        self.n_classes = max(trees.config.n_classes or 2, 2)

    def values(self, x: np.ndarray) -> np.ndarray:
        v = np.zeros((len(x), len(self.ids)))
        place = {t: i for i, t in enumerate(self.ids)}
        for parts in blocks_of(self.model):
            for t in parts:
                v[:, place[int(t["tree_id"])]] += t["value"][descend(t, x, self.cut)]
        return v

    def pieces(self, batches):
        """(rows' features, values, states) of at most CELLS values each."""
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf[self.features])
            state = matrix(pdf["state"]) if self.has_state else None
            step = max(1, CELLS // (len(self.ids) * self.n_classes))
            for at in range(0, len(x), step):
                yield pdf[self.features].iloc[at : at + step], self.values(x[at : at + step]), None if state is None else state[at : at + step]


def merged_state(data: DataFrame, trees: Trees, rule: str) -> DataFrame:
    """The rows' features with their state, after these trees are added."""
    s = Scoring(data, trees)
    n_classes = s.n_classes if rule == "votes" else None

    def run(batches):
        for x, v, state in s.pieces(batches):
            yield pd.DataFrame({s.features: x.to_numpy(), "state": list(_merged(v, state, n_classes))})

    return data.select(s.columns).mapInPandas(run, f"{s.features} {data.schema[s.features].dataType.simpleString()}, state array<double>")


def row_report(data: DataFrame, trees: Trees, rule: str, seen: int = 0) -> DataFrame:
    """(c, stable, max_change) of the rule "votes", "regression" or "updates" over rows with features x, or their bins b.

    The same figures as stability_votes, stability_regression and stability_updates of all rows' predictions. With a
    state of seen earlier trees the trees are those after them, and c goes on from there.
    """
    s = Scoring(data, trees)
    c = seen + np.arange(1, len(s.ids) + 1)

    def scan(count):
        """Sums, by number of trees, of what count(values, state) says: (stable, least mean, largest mean, largest change)."""

        def run(batches):
            for _, v, state in s.pieces(batches):
                ok, lo, hi, change = count(v, state)
                yield pd.DataFrame({"c": c, "rows": len(v), "ok": ok, "lo": lo, "hi": hi, "change": change})

        got = data.select(s.columns).mapInPandas(run, "c int, rows long, ok long, lo double, hi double, change double")
        return got.groupBy("c").agg(F.sum("rows").alias("rows"), F.sum("ok").alias("ok"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("change").alias("change"))

    def votes(v, state):
        counts = np.cumsum(v[:, :, None] == np.arange(s.n_classes), axis=1) + (0 if state is None else state[:, None])
        shares = np.sort(counts / c[:, None], axis=2)
        ok = _interval(shares[..., -1], c)[0] > _interval(shares[..., -2], c)[1]
        return ok.sum(axis=0), 0.0, 0.0, 0.0

    def updates(v, state):
        mean, _, change = _running(v, state, seen)
        lo, hi = _interval(np.clip(1 / (1 + np.exp(-np.clip(mean, -700, 700))), 1e-6, 1 - 1e-6), c)
        return ((hi < 0.5) | (lo > 0.5)).sum(axis=0), 0.0, 0.0, change.max(axis=0)

    def spans(v, state):
        mean, _, change = _running(v, state, seen)
        return 0, mean.min(axis=0), mean.max(axis=0), change.max(axis=0)

    if rule == "regression":
        ends = {r["c"]: max(r["hi"] - r["lo"], 1e-10) for r in scan(spans).collect()}  # a row for each number of trees
        spread = np.array([ends[k] for k in sorted(ends)])

        def narrow(v, state):
            _, var, change = _running(v, state, seen)
            half = Z * np.sqrt(var / c)
            return (half < 0.05 * spread).sum(axis=0), 0.0, 0.0, change.max(axis=0)

        got = scan(narrow)
    else:
        got = scan(votes if rule == "votes" else updates)
    out = got.select("c", (F.col("ok") / F.col("rows")).alias("stable"), F.when(F.col("c") > 1, F.col("change")).alias("max_change"))
    return out.drop("max_change") if rule == "votes" else out


def grow_until_stable(data: DataFrame, config, edges, n_features: int, tol: float, min_trees: int | None = None, rule: str | None = None, batch: int | None = None) -> tuple[Trees, int]:
    """Grows config.n_trees trees at most, and keeps the prefix at which the rule first holds."""
    rule = rule or ("votes" if config.classification else "regression")
    n = config.n_trees
    least = max(n // 10, 3) if min_trees is None else min_trees
    batch = batch or max(least, 8)
    out = Trees(config, edges, n_features)
    scored = data
    for at in range(0, n, batch):
        more = grow(data, copy(config), edges, n_features, list(range(at, min(n, at + batch))))
        out.add(more)
        used = first_stable(row_report(scored, more, rule, at), least, 0.0 if config.classification else tol).first()["trees_used"]
        if used is not None:
            out.keep(used)
        if used is None and at + batch < n:  # the rows' state goes on, the generation before goes
            before, scored = scored, materialised(merged_state(scored, more, rule), "votes")
            if before is not data:
                dropped(before)
        else:
            break
    if scored is not data:
        dropped(scored)
    return out, n if used is None else int(used)
