"""Exact path-dependent Shapley values of one tree.

A tree is a sum over its leaves of value x product over the path's features of
(follow the row if the feature is known, else the path's share of cover), so
each leaf is a product game on its own features; its Shapley values have a
closed form in the coefficients of a polynomial, and no coalition is ever
enumerated. Covers are counts of the given training rows over the sample counts
the tree was grown with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse import schema
from copse.functions.scalar import shapley_weight
from copse.operators.grow import Trees, matrix


def covers(trees: Trees, frame: DataFrame) -> dict[int, float]:
    """Rows of frame (row_id, x) that pass each node of tree 0, by one grouped count."""
    from copse.operators.score import per_tree

    at_leaf = {r["leaf"]: r["n"] for r in per_tree(frame, trees).filter("tree_id = 0").groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    out: dict[int, float] = {i: 0.0 for _, i in trees.nodes}
    for leaf, n in at_leaf.items():
        while True:
            out[leaf] += n
            if leaf == 0:
                break
            leaf = (leaf - 1) // 2
    return out


def leaf_paths(trees: Trees, cover: dict[int, float]) -> list[tuple[list[float], list[tuple[int, float, float, float]]]]:
    """For each leaf: its outputs, and per feature of its path (feature, low, high, share of cover): low < x <= high."""
    if trees.rest is not None or any(i < 0 for _, i in trees.nodes):
        raise ValueError("attributions need a tree that the driver holds, of at most 61 levels: set max_depth or min_samples_leaf")
    out = []
    for (t, i), n in trees.nodes.items():
        if t != 0 or not n.is_leaf:
            continue
        box: dict[int, list[float]] = {}
        while i:
            up = (i - 1) // 2
            p = trees.nodes[0, up]
            b = box.setdefault(p.feature, [-np.inf, np.inf, 1.0])
            if i == 2 * up + 1:
                b[1] = min(b[1], p.threshold)
            else:
                b[0] = max(b[0], p.threshold)
            b[2] *= cover[i] / p.samples if p.samples else 0.0
            i = up
        values = trees.shares(n) if trees.config.classification else [trees.value(n)]
        out.append((values, [(f, *b) for f, b in sorted(box.items())]))
    return out


def shapley_batch(paths, x: np.ndarray, n_outputs: int) -> np.ndarray:
    """(rows, outputs, features)."""
    phi = np.zeros((len(x), n_outputs, x.shape[1]))
    for values, box in paths:
        k = len(box)
        if not k:
            continue
        weights = [shapley_weight(s, k - 1) for s in range(k)]
        one = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in box]
        zero = [z for *_, z in box]
        for j, (f, *_) in enumerate(box):
            poly = [np.ones(len(x))]
            for m in range(k):
                if m != j:
                    nxt = [p * zero[m] for p in poly] + [np.zeros(len(x))]
                    for s, p in enumerate(poly):
                        nxt[s + 1] = nxt[s + 1] + p * one[m]
                    poly = nxt
            share = sum(w * p for w, p in zip(weights, poly, strict=True)) * (one[j] - zero[j])
            for o, v in enumerate(values):
                phi[:, o, f] += v * share
    return phi


def explain(frame: DataFrame, trees: Trees, train: DataFrame) -> DataFrame:
    """(row_id, output, feature, phi) of frame (row_id, x); train (row_id, x) gives the covers."""
    n_out = trees.config.n_classes if trees.config.classification else 1
    paths = frame.sparkSession.sparkContext.broadcast(leaf_paths(trees, covers(trees, train)))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            phi = shapley_batch(paths.value, matrix(pdf["x"]), n_out)
            n, o, p = phi.shape
            yield pd.DataFrame({"row_id": np.repeat(pdf["row_id"].to_numpy(), o * p), "output": np.tile(np.repeat(np.arange(o), p), n), "feature": np.tile(np.arange(p), n * o), "phi": phi.ravel()})

    return frame.select("row_id", "x").mapInPandas(run, schema.SHAP)


def base_values(trees: Trees, train: DataFrame) -> list[float]:
    """The tree's value with nothing known, by output."""
    n_out = trees.config.n_classes if trees.config.classification else 1
    out = [0.0] * n_out
    for values, box in leaf_paths(trees, covers(trees, train)):
        share = float(np.prod([z for *_, z in box])) if box else 1.0
        out = [a + share * v for a, v in zip(out, values, strict=True)]
    return out


__all__ = ["base_values", "covers", "explain", "leaf_paths", "shapley_batch"]
