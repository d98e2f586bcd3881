"""The rest of a tree below one node of few rows, grown in one task.

The rows of the node are held as arrays and grown level by level, all open nodes
of a level at once: rows are sorted by (node, value), equal values are summed,
and running sums within a node are taken over the nodes' values laid out as rows
of a matrix, nodes of like size together. Candidates, gains, limits and ties are
those of ``split``, so a tree is the same whichever of the two grew a node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from copse.operators.trees import HEAP_LEVELS, REST, TreeConfig, feature_subset

COLUMNS = [c.split()[0] for c in REST.split(", ")]
TOLERANCE = 1e-12
#: More than the bins of a feature.
SPAN = 1 << 15


def impurity(sums: np.ndarray, classification: bool) -> np.ndarray:
    """Of sums whose last axis is (n, w, sums...): Gini or weighted variance."""
    w = sums[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if classification:
            out = np.ones(w.shape)
            for c in range(2, sums.shape[-1]):  # in the order of the column form, so that equal gains are equal
                share = sums[..., c] / w
                out = out - share * share
            return out
        mean = sums[..., 2] / w
        return sums[..., 3] / w - mean * mean


def _rows_of_matrix(lengths: np.ndarray):
    """Groups of nodes of like size: (nodes, width), so that no matrix is over twice as large as its nodes."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(kind[lengths > 1]):
        own = np.flatnonzero((kind == k) & (lengths > 1))
        yield own, int(lengths[own].max())


def best_splits(g: np.ndarray, v: np.ndarray, parts: np.ndarray, k: int, config: TreeConfig, sign: int, exact: bool):
    """Of one feature, for nodes 0..k-1: (gain, value, threshold, left sums, node sums), gain -inf where nothing is admissible."""
    gain, value, threshold = np.full(k, -np.inf), np.zeros(k), np.zeros(k)
    left, total = np.zeros((k, parts.shape[1])), np.zeros((k, parts.shape[1]))
    order = np.lexsort((v, g)) if exact else np.argsort(g * SPAN + v, kind="stable")
    gs, vs = g[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], (gs[1:] != gs[:-1]) | (vs[1:] != vs[:-1]))))
    sums, node, val = np.add.reduceat(parts[order], first, axis=0), gs[first], vs[first]
    lengths = np.bincount(node, minlength=k)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for own, width in _rows_of_matrix(lengths):
        column = np.arange(width)
        there = column < lengths[own][:, None]
        at = np.where(there, begin[own][:, None] + column, 0)
        upto = np.cumsum(np.where(there[..., None], sums[at], 0.0), axis=1)
        whole = upto[:, -1:]
        rest = whole - upto
        ok = (upto[..., 0] >= config.min_samples_leaf) & (rest[..., 0] >= config.min_samples_leaf) & (upto[..., 1] > 0) & (rest[..., 1] > 0)
        if sign and not config.classification:
            with np.errstate(divide="ignore", invalid="ignore"):
                lmean, rmean = upto[..., 2] / upto[..., 1], rest[..., 2] / rest[..., 1]
            ok &= lmean <= rmean if sign > 0 else lmean >= rmean
        parent = impurity(whole, config.classification)
        with np.errstate(invalid="ignore", divide="ignore"):
            g_ = parent - (upto[..., 1] * impurity(upto, config.classification) + rest[..., 1] * impurity(rest, config.classification)) / whole[..., 1]
        g_ = np.where(ok & (g_ > TOLERANCE * np.maximum(1.0, parent)), g_, -np.inf)
        place = g_.argmax(axis=1)  # the lowest value among equals
        row = np.arange(len(own))
        gain[own], left[own], total[own] = g_[row, place], upto[row, place], whole[:, 0]
        value[own] = val[at[row, place]]
        beyond = val[at[row, np.minimum(place + 1, width - 1)]]
        threshold[own] = (value[own] + beyond) / 2 if exact else value[own]
    return gain, value, threshold, left, total


def grow_rest(values: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray, config: TreeConfig, cuts: list[np.ndarray] | None, tree: int, root: int, part: int, depth: int, lower: float, upper: float, max_depth: int | None) -> pd.DataFrame:
    """Rows of REST for the node root and all below it. values: bins, or values where cuts is None (exact splits).

    part numbers the roots of a tree: nodes deeper than heap ids go have ids from a range of its own.
    """
    spare = -1 - (part << 32)
    order = np.lexsort((m, w, y, *values.T))  # sums in one order, in whatever order the rows arrive
    values, y, w, m = values[order], y[order], w[order], m[order]
    weight = w * m
    per = [np.where(y.astype(int) == c, weight, 0.0) for c in range(config.width)] if config.classification else [weight * y, weight * y * y]
    parts = np.stack([m.astype(float), weight, *per], axis=1)
    g = np.zeros(len(y), np.int64)
    ids, sums = np.array([root], np.int64), parts.sum(axis=0)[None]
    low, high = np.array([lower]), np.array([upper])
    p = values.shape[1]
    features = [f for f in range(p) if cuts is None or len(cuts[f]) > 1]
    subset = config.max_features is not None and config.max_features < p
    out = []
    while len(ids):
        k = len(ids)
        gain, feature, value, threshold = np.full(k, -np.inf), np.full(k, -1), np.full(k, np.nan), np.full(k, np.nan)
        left, total = np.zeros_like(sums), sums.copy()
        open_ = (sums[:, 0] >= config.min_samples_split) & (max_depth is None or depth < max_depth)
        tried = [set(feature_subset(config, p, tree, i)) if o else set() for i, o in zip(ids.tolist(), open_, strict=True)] if subset else None
        for f in features if open_.any() else ():
            use = open_ if tried is None else np.array([f in t for t in tried]) & open_
            rows = slice(None) if use.all() else np.flatnonzero(use[g])
            if not use.any() or not len(g[rows]):
                continue
            sign = config.monotone[f] if config.monotone else 0
            found, v, t, ls, ts = best_splits(g[rows], values[rows, f], parts[rows], k, config, sign, cuts is None)
            better = found > gain
            gain[better], feature[better], value[better], threshold[better], left[better], total[better] = found[better], f, v[better], t[better], ls[better], ts[better]
        cut = feature >= 0
        if cuts is not None:
            threshold[cut] = [cuts[f][int(b)] for f, b in zip(feature[cut], value[cut], strict=True)]
        at = np.flatnonzero(cut)
        kids = np.zeros((k, 2), np.int64)
        if depth < HEAP_LEVELS:
            kids[at, 0], kids[at, 1] = 2 * ids[at] + 1, 2 * ids[at] + 2
        else:
            kids[at] = spare - np.arange(2 * len(at)).reshape(-1, 2)
            spare -= 2 * len(at)
        out.append(pd.DataFrame({"tree_id": np.int32(tree), "root_id": np.int64(root), "node_id": ids, "depth": np.int32(depth), "feature": feature.astype(np.int32), "threshold": threshold, "bin": value, "left_id": kids[:, 0], "right_id": kids[:, 1], "samples": sums[:, 0].round().astype(np.int64), "weight": sums[:, 1], "sums": list(sums[:, 2:]), "gain": np.where(cut, gain, np.nan), "lower": low, "upper": high})[COLUMNS])
        if not len(at):
            break
        right = total[at] - left[at]
        (ll, lu), (rl, ru) = bounds(config, feature[at], low[at], high[at], left[at], right)
        both = lambda a, b: np.stack([a, b], axis=1).reshape(2 * len(at), *a.shape[1:])
        place = np.full(k, -1)
        place[at] = np.arange(len(at))
        live = cut[g]
        g, values, parts = g[live], values[live], parts[live]
        v = values[np.arange(len(g)), feature[g]]
        g = 2 * place[g] + (v > (value if cuts is not None else threshold)[g])
        ids, sums, low, high = kids[at].reshape(-1), both(left[at], right), both(ll, rl), both(lu, ru)
        depth += 1
    return pd.concat(out, ignore_index=True)


def bounds(config: TreeConfig, feature, low, high, left, right):
    """Limits of leaf values of the left and the right children, from sums (n, w, sum wy, ...)."""
    if not config.monotone or config.classification:
        return (low, high), (low, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = lambda s: np.where(s[:, 1] > 0, s[:, 2] / s[:, 1], 0.0)
        mid = np.minimum(np.maximum((mean(left) + mean(right)) / 2, low), high)
    sign = np.array([config.monotone[f] for f in feature])
    return (np.where(sign < 0, mid, low), np.where(sign > 0, mid, high)), (np.where(sign > 0, mid, low), np.where(sign < 0, mid, high))
