"""Grown trees: the nodes that the driver holds, and those that stay in a table.

Nodes near the roots come from level-wise growth and are few. Below, where one
task grew the rest of a tree, nodes are rows of a stored table (``REST``) by tree
and by root of the part. A model of up to ``LOAD_NODES`` nodes is taken to the
driver whole; a larger one stays in the table, and scoring takes it in blocks of
``BLOCK_NODES`` nodes, each of which is one broadcast: neither the driver nor a
task holds more than a block of it at a time. A tree may lie in several blocks;
a row gets its value from the block with its leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse import schema
from copse.functions.scalar import draw, draw_py

LOAD_NODES, BLOCK_NODES = 200_000, 500_000
#: Levels whose heap ids fit a long.
HEAP_LEVELS = 61
REST = "tree_id int, root_id long, node_id long, depth int, feature int, threshold double, bin double, left_id long, right_id long, samples long, weight double, sums array<double>, gain double, lower double, upper double"


@dataclass
class TreeConfig:
    classification: bool = True
    n_classes: int = 2
    n_trees: int = 1
    max_depth: int | None = 6
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    monotone: list[int] = field(default_factory=list)
    exact: bool = False
    bootstrap: str | bool = False  # False, "rows" (n draws a tree, made in the row), "exact" (n draws from a shuffled table) or "poisson"
    seed: int = 0
    rows: int = 0  # number of rows, for draws in the row
    finish_rows: int = 50_000  # a node of so many rows or fewer is finished in one task,
    finish_levels: int = 4  # if it may have more levels than these below it
    subtract: bool = True  # histograms of the larger child by subtraction

    @property
    def width(self) -> int:
        return self.n_classes if self.classification else 2


def feature_subset(config: TreeConfig, p: int, tree: int, node: int) -> list[int]:
    """Features tried at a node: the lowest hashes, all where max_features isn't under p."""
    k = config.max_features
    if k is None or k >= p:
        return list(range(p))
    return sorted(sorted(range(p), key=lambda f: (draw_py(config.seed, "feat", tree, node, f), f))[:k])


def features_tried(config: TreeConfig, p: int, tree: Column, node: Column) -> Column:
    """The same features as an array column, the lowest hash first, for nodes that are rows."""
    k = p if config.max_features is None else min(config.max_features, p)
    drawn = F.array(*[F.struct(draw(config.seed, F.lit("feat"), tree, node, F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in range(p)])
    return F.transform(F.slice(F.array_sort(drawn), 1, k), lambda x: x["f"])


@dataclass
class Node:
    tree_id: int
    node_id: int
    depth: int
    samples: int
    weight: float
    sums: list[float]
    lower: float = -np.inf
    upper: float = np.inf
    feature: int = -1
    threshold: float | None = None
    bin: float | None = None
    gain: float | None = None
    kids: tuple[int, int] | None = None  # ids of the children, where they aren't heap ids
    rows: float = np.inf  # rows of the data that samples are draws of, while the tree is grown

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0

    @property
    def left_id(self) -> int:
        return self.kids[0] if self.kids else 2 * self.node_id + 1

    @property
    def right_id(self) -> int:
        return self.kids[1] if self.kids else 2 * self.node_id + 2


def leaf_values(config: TreeConfig, sums: np.ndarray, weight: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The class of the largest sum (ties: the highest class), or the mean within its limits."""
    if config.classification:
        return (sums.shape[1] - 1 - sums[:, ::-1].argmax(axis=1)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(weight > 0, sums[:, 0] / weight, 0.0)
    return np.minimum(np.maximum(mean, lower), upper)


class Trees:
    """Grown trees: nodes by (tree, id), and rest, the table of what lies below ``roots`` where the model is large.

    Ids are heap ids down to ``HEAP_LEVELS``; nodes further down have negative ids, and their parents name them.
    """

    def __init__(self, config: TreeConfig, edges: list[list[float]] | None, n_features: int):
        self.config, self.edges, self.n_features = config, edges, n_features
        self.nodes: dict[tuple[int, int], Node] = {}
        self.rest: DataFrame | None = None
        self.roots: dict[tuple[int, int], int] = {}  # (tree, root of a part in the table) -> nodes of the part

    def value(self, n: Node) -> float:
        if self.config.classification:
            return float(max(range(len(n.sums)), key=lambda k: (n.sums[k], k)))  # ties: the highest class
        v = n.sums[0] / n.weight if n.weight > 0 else 0.0
        return float(min(max(v, n.lower), n.upper))

    def shares(self, n: Node) -> list[float]:
        t = sum(n.sums)
        return [s / t if t > 0 else 0.0 for s in n.sums]

    # --- parts in the table --------------------------------------------------

    def attach(self, rest: DataFrame, roots: dict[tuple[int, int], int]) -> None:
        """Adds finished parts, given their numbers of nodes by root: to the driver's nodes if the model is small, else as a table."""
        self.roots |= roots
        self.rest = rest if self.rest is None else self.rest.unionByName(rest)
        if len(self.nodes) + sum(self.roots.values()) <= LOAD_NODES:
            for r in self.rest.toLocalIterator():
                leaf = r["feature"] < 0
                self.nodes[r["tree_id"], r["node_id"]] = Node(r["tree_id"], r["node_id"], r["depth"], r["samples"], r["weight"], list(r["sums"]), r["lower"], r["upper"], r["feature"], *((None, None, None, None) if leaf else (r["threshold"], r["bin"], r["gain"], (r["left_id"], r["right_id"]))))
            self.rest, self.roots = None, {}

    def keep(self, n_trees: int) -> None:
        """Only the first n_trees trees stay."""
        self.nodes = {k: n for k, n in self.nodes.items() if k[0] < n_trees}
        self.roots = {k: n for k, n in self.roots.items() if k[0] < n_trees}
        self.rest = None if self.rest is None else self.rest.filter(F.col("tree_id") < n_trees)

    def add(self, other: Trees) -> None:
        self.nodes |= other.nodes
        if other.rest is not None:
            self.attach(other.rest, other.roots)

    @property
    def tree_ids(self) -> list[int]:
        return sorted({t for t, _ in self.nodes})

    def n_nodes(self) -> int:
        return len(self.nodes) + sum(self.roots.values()) - len(self.roots)

    def _inner(self) -> list[Node]:
        """The driver's nodes but for the roots of parts that the table has."""
        return [n for k, n in self.nodes.items() if k not in self.roots]

    def depth(self) -> int:
        own = max((n.depth for n in self.nodes.values()), default=0)
        return own if self.rest is None else max(own, self.rest.agg(F.max("depth")).first()[0])

    def n_leaves(self) -> int:
        own = sum(n.is_leaf for n in self._inner())
        return own if self.rest is None else own + self.rest.filter("feature < 0").count()

    def samples_by_feature(self) -> dict[int, int]:
        """Samples over the inner nodes of each feature."""
        out: dict[int, int] = {}
        for n in self._inner():
            if not n.is_leaf:
                out[n.feature] = out.get(n.feature, 0) + n.samples
        if self.rest is not None:
            for r in self.rest.filter("feature >= 0").groupBy("feature").agg(F.sum("samples").alias("s")).collect():  # a row for each feature
                out[r["feature"]] = out.get(r["feature"], 0) + r["s"]
        return out

    def widest_feature(self, tree: int) -> int | None:
        """The largest feature that a tree splits on."""
        own = [n.feature for n in self._inner() if n.tree_id == tree and not n.is_leaf]
        if self.rest is not None and (top := self.rest.filter(F.col("tree_id") == tree).agg(F.max("feature")).first()[0]) is not None and top >= 0:
            own.append(top)
        return max(own, default=None)

    # --- the model as rows ---------------------------------------------------

    def rows(self, model_id: str = "model", round: int = 0, output: int = 0) -> list[tuple]:
        """Rows of the driver's nodes."""
        out = []
        for n in sorted(self._inner(), key=lambda n: (n.tree_id, n.node_id)):
            leaf = n.is_leaf
            out.append((model_id, round, output, n.tree_id, n.node_id, n.depth, leaf, n.feature, n.threshold, None if n.bin is None or self.config.exact else int(n.bin), None if leaf else n.left_id, None if leaf else n.right_id, self.value(n) if leaf else 0.0, n.samples, float(n.weight), [float(s) for s in n.sums] if self.config.classification else None, n.gain, float(n.lower), float(n.upper)))
        return out

    def _rest_rows(self, model_id: str, round: int, output: int) -> DataFrame:
        leaf, cls = F.col("feature") < 0, self.config.classification
        inner = lambda c: F.when(~leaf, c)
        if cls:
            value = (F.size("sums") - F.array_position(F.reverse("sums"), F.array_max("sums"))).cast("double")
        else:
            value = F.least(F.greatest(F.when(F.col("weight") > 0, F.col("sums")[0] / F.col("weight")).otherwise(0.0), "lower"), "upper")
        return self.rest.select(
            F.lit(model_id).alias("model_id"), F.lit(round).alias("round"), F.lit(output).alias("output"), "tree_id", "node_id", "depth", leaf.alias("is_leaf"), "feature", inner(F.col("threshold")).alias("threshold"),
            (F.lit(None) if self.config.exact else inner(F.col("bin"))).cast("int").alias("bin"), inner(F.col("left_id")).alias("left_id"), inner(F.col("right_id")).alias("right_id"),
            F.when(leaf, value).otherwise(0.0).alias("value"), "samples", "weight", (F.col("sums") if cls else F.lit(None).cast("array<double>")).alias("class_weights"), inner(F.col("gain")).alias("gain"), "lower", "upper",
        )

    def table(self, spark, model_id: str = "model", round: int = 0, output: int = 0) -> DataFrame:
        own = spark.createDataFrame(self.rows(model_id, round, output), schema.MODEL)
        return own if self.rest is None else own.unionByName(self._rest_rows(model_id, round, output))

    # --- the model as arrays -------------------------------------------------

    def arrays(self) -> list[dict[str, np.ndarray]]:
        """Per tree, by id: tree_id, root (its place), feature, threshold, bin, left, right, value, shares, node_id, samples. For models that the driver holds."""
        if self.rest is not None:
            raise ValueError("a model in a table is read in blocks")
        return self._arrays({t: [] for t in self.tree_ids})

    def _arrays(self, parts: dict[int, list]) -> list[dict[str, np.ndarray]]:
        """Arrays of the named trees: the driver's nodes and these parts of each; real is false at roots of parts that aren't there."""
        by_tree: dict[int, list[Node]] = {t: [] for t in parts}
        for n in self.nodes.values():
            if n.tree_id in by_tree:
                by_tree[n.tree_id].append(n)
        out = []
        for t, tables in parts.items():
            there = {int(r) for x in tables for r in np.unique(x["root_id"])}
            own = [n for n in by_tree[t] if n.node_id not in there]
            cat = lambda name, mine: np.concatenate([np.array(mine), *[x[name] for x in tables]]) if tables else np.array(mine)  # noqa: B023, E731
            ids = cat("node_id", [n.node_id for n in own]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            feature = cat("feature", [n.feature for n in own]).astype(np.int32)[order]
            width = self.config.width
            sums = np.concatenate([np.array([n.sums for n in own], float).reshape(len(own), -1)[:, :width], *[x["sums"] for x in tables]])[order] if own or tables else np.zeros((0, width))
            weight = cat("weight", [float(n.weight) for n in own]).astype(float)[order]
            leaf = feature < 0
            kids = lambda name, mine: np.where(leaf, -1, np.searchsorted(ids, cat(name, mine).astype(np.int64)[order])).astype(np.int32)  # noqa: B023, E731
            value = leaf_values(self.config, sums, weight, cat("lower", [n.lower for n in own]).astype(float)[order], cat("upper", [n.upper for n in own]).astype(float)[order])
            total = sums.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = np.where(total > 0, sums / total, 0.0) if self.config.classification else np.zeros((len(ids), 0))
            real = np.array([(t, int(i)) not in self.roots or int(i) in there for i in ids.tolist()]) if self.roots else np.ones(len(ids), bool)
            blank = np.nan
            out.append({
                "tree_id": np.int64(t), "feature": feature, "node_id": ids, "real": real,
                "threshold": cat("threshold", [blank if n.threshold is None else n.threshold for n in own]).astype(float)[order],
                "bin": cat("bin", [blank if n.bin is None else n.bin for n in own]).astype(float)[order],
                "left": kids("left_id", [0 if n.is_leaf else n.left_id for n in own]), "right": kids("right_id", [0 if n.is_leaf else n.right_id for n in own]), "root": int(np.searchsorted(ids, 0)),
                "value": np.where(leaf & real, value, 0.0), "shares": np.where(real[:, None], shares, 0.0),
                "samples": cat("samples", [n.samples for n in own]).astype(np.int64)[order],
            })
        return out

    def blocks(self) -> list:
        """Makers of arrays of at most BLOCK_NODES nodes of parts each (and the driver's nodes of their trees); every leaf is in one."""
        if self.rest is None:
            return [self.arrays]
        units: list[list[tuple[int, int]]] = [[]]
        size = 0
        for (t, root), n in sorted(self.roots.items()):
            if units[-1] and size + n > BLOCK_NODES:
                units.append([])
                size = 0
            units[-1].append((t, root))
            size += n
        # the leaves that the driver holds count once: in the first block that has their tree
        whole = [t for t in self.tree_ids if t not in {k for k, _ in self.roots}]
        return [lambda own=own, extra=whole if i == 0 else [], seen={t for u in units[:i] for t, _ in u}: self._block(own, extra, seen) for i, own in enumerate(units)]

    def _block(self, units: list[tuple[int, int]], whole: list[int], seen: set[int]) -> list[dict[str, np.ndarray]]:
        spark = self.rest.sparkSession
        keys = spark.createDataFrame(units, "tree_id int, root_id long")
        lo, hi = units[0][0], units[-1][0]
        found = self.rest.filter(F.col("tree_id").between(lo, hi)).join(F.broadcast(keys), ["tree_id", "root_id"], "left_semi").toArrow()  # at most BLOCK_NODES rows
        cols = {c: found.column(c).to_numpy() for c in ("tree_id", "root_id", "node_id", "feature", "threshold", "bin", "left_id", "right_id", "samples", "weight", "lower", "upper")}
        sums = found.column("sums").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        parts: dict[int, list] = {t: [] for t in sorted({*whole, *(t for t, _ in units)})}
        for t in np.unique(cols["tree_id"]):
            own = cols["tree_id"] == t
            parts[int(t)].append({c: v[own] for c, v in cols.items()} | {"sums": sums[own]})
        out = self._arrays(parts)
        for a in out:
            if int(a["tree_id"]) in seen:  # its leaves at the driver have been counted by an earlier block
                mine = np.array([(int(a["tree_id"]), int(i)) in self.nodes and (int(a["tree_id"]), int(i)) not in self.roots for i in a["node_id"].tolist()])
                a["value"], a["shares"], a["real"] = np.where(mine, 0.0, a["value"]), np.where(mine[:, None], 0.0, a["shares"]), a["real"] & ~mine
        return out


def descend(tree: dict[str, np.ndarray], x: np.ndarray, cut: str = "threshold") -> np.ndarray:
    """Index of the node each row of x (values, or bins with cut "bin") ends in."""
    at = np.full(len(x), tree["root"], np.int32)
    live = np.arange(len(x)) if len(x) and tree["feature"][tree["root"]] >= 0 else np.zeros(0, np.int64)
    while len(live):
        n = at[live]
        f = tree["feature"][n]
        go = x[live, f] <= tree[cut][n]
        at[live] = np.where(go, tree["left"][n], tree["right"][n])
        live = live[tree["feature"][at[live]] >= 0]
    return at
