"""Level-wise growth of many trees at once, as Spark jobs over row partitions.

Each level, a job adds every row to the histograms of the nodes still open; per
partition that is NumPy on Arrow batches, and what leaves the partition is the
histogram, not the rows. The histograms are summed by a shuffle on (tree, node,
feature, bin), and the split search is the DataFrame plan of ``split``. Where all
features are tried, only the smaller child of a split is counted; the other's
histogram is the parent's, kept as a table, less its. Rows are never copied per
tree: a bootstrap is a multiplicity per tree. Without one, equal rows are one row
with their number as its multiplicity where trees are deep.

Rows carry the node that they are in, per tree. A level moves them by the last
splits only; every ``ROUTE_LEVELS`` levels the rows are written with their nodes,
and the generation before is dropped, so a level costs the same however deep it
is.

An open node of at most ``finish_rows`` rows (however often drawn), without a
bootstrap the root too, leaves the levels: at the end its
rows go by (tree, node) to one task, which grows the rest (``subtree``). What it
finds is a table; see ``trees`` for how large models are kept and scored. The
driver holds the nodes above: about 2 n / finish_rows a tree, ``MAX_NODES`` in
all, beyond which a larger finish_rows is asked for. Trees are grown in groups so
that a task's histograms stay under ``HIST_CELLS`` cells, and finished in groups
of ``FINISH_DRAWS`` rows. Levels end with the heap ids that fit a long, at depth 61;
below, only parts that one task grows go on, to any depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.functions.scalar import draw
from copse.operators import draws, split
from copse.operators.binning import assign_bins, matrix
from copse.operators.subtree import grow_rest
from copse.operators.trees import HEAP_LEVELS, REST, Node, TreeConfig, Trees, descend, feature_subset
from copse.sources.frames import dropped, materialised, with_rank

MAX_NODES, HIST_CELLS = 2_000_000, 4_000_000
ROUTE_LEVELS, FINISH_DRAWS = 3, 2_000_000_000


def bootstrap_counts(spark, n: int, n_trees: int, seed: int) -> DataFrame:
    """(rank, tree_id, m): n draws with replacement per tree."""
    d = spark.range(n * n_trees).select((F.col("id") / n).cast("long").cast("int").alias("tree_id"), F.col("id"))
    return d.select("tree_id", (draw(seed, F.lit("boot"), F.col("id")) % n).alias("rank")).groupBy("rank", "tree_id").agg(F.count("*").cast("int").alias("m"))


def with_multiplicity(frame: DataFrame, config: TreeConfig) -> DataFrame:
    """Adds m array<int>, one count per tree (null: the kernels make the draws, or all ones). frame has rank, the 0-based row number, for exact draws."""
    if config.bootstrap != "exact":
        return frame.withColumn("m", F.lit(None).cast("array<int>"))
    n = frame.count()
    counts = bootstrap_counts(frame.sparkSession, n, config.n_trees, config.seed).groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("tree_id", "m"))).alias("by_tree"))
    joined = frame.join(counts, "rank", "left")
    m = F.transform(F.sequence(F.lit(0), F.lit(config.n_trees - 1)), lambda t: F.coalesce(F.col("by_tree")[t], F.lit(0)))
    return joined.withColumn("m", m).drop("by_tree")


def row_draws(frame: DataFrame, config: TreeConfig) -> DataFrame:
    """(row_id, tree_id, m) of rows drawn in the row; frame has row_id and rank."""
    trees = list(range(config.n_trees))

    def run(batches):
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            for t in trees:
                m = draws.counts(config.seed, t, config.rows, rank)
                own = m > 0
                yield pd.DataFrame({"row_id": pdf["row_id"][own], "tree_id": np.int32(t), "m": m[own].astype(np.int32)})

    return frame.select("row_id", "rank").mapInPandas(run, "row_id long, tree_id int, m int")


# --- kernels over rows -----------------------------------------------------


class Batch:
    """Arrays of an Arrow batch of rows, and the moves that a state table hasn't got yet."""

    def __init__(self, batch, config: TreeConfig, place: dict[int, int]):
        self.batch, self.config, self.place, self.n = batch, config, place, batch.num_rows
        self.values = self._lists("x" if config.exact else "b")
        self.at = self._lists("at") if "at" in batch.schema.names else None
        m = batch.column("m")
        self.m = None if m.null_count == len(m) else self._lists("m")

    def _lists(self, name: str) -> np.ndarray:
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def multiplicity(self, t: int) -> np.ndarray:
        c = self.config
        if self.m is not None:
            return self.m[:, t if self.m.shape[1] > 1 else 0].astype(np.int64)  # one count for all trees, or one for each
        if c.bootstrap == "poisson":
            return draws.poisson_counts(c.seed, t, self.column("row_id"))
        if c.bootstrap == "rows":
            return draws.counts(c.seed, t, c.rows, self.column("rank"))
        return np.ones(self.n, np.int64)

    def nodes(self, t: int, moves) -> np.ndarray:
        """The node of each row in tree t, by the splits made since the state was written."""
        node = np.zeros(self.n, np.int64) if self.at is None else self.at[:, self.place[t]].astype(np.int64)
        if t not in moves:
            return node
        ids, feature, cut, levels = moves[t]
        for _ in range(levels):
            i = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            go = np.flatnonzero(ids[i] == node)
            if not len(go):
                break
            i = i[go]
            node[go] = 2 * node[go] + 1 + (self.values[go, feature[i]] > cut[i])
        return node


def _moves(splits: dict[int, list[Node]], levels: int, exact: bool) -> dict:
    out = {}
    for t, nodes in splits.items():
        if nodes:
            nodes = sorted(nodes, key=lambda n: n.node_id)
            out[t] = (np.array([n.node_id for n in nodes], np.int64), np.array([n.feature for n in nodes], np.int64), np.array([n.threshold if exact else n.bin for n in nodes], float), levels)
    return out


def _level_kernel(moves, asked, allowed, whole: bool, config: TreeConfig, place, p: int, n_bins: list[int] | None):
    width, exact = config.width + 1, config.exact  # the last sum is the number of rows
    columns = ["tree_id", "node_id", "feature", "bin", "n", "w", *[f"s{k}" for k in range(width)]]

    def run(batches):
        import pyarrow as pa

        def out(d):
            return pa.RecordBatch.from_pandas(pd.DataFrame(d)[columns].astype({"tree_id": "int32", "node_id": "int64", "feature": "int32", "bin": float, "n": "int64"}), preserve_index=False)

        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Batch(batch, config, place)
            y, w = rows.column("y"), rows.column("w")
            for t, ids in asked.items():
                mult, node = rows.multiplicity(t), rows.nodes(t, moves)
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                own = np.flatnonzero((mult > 0) & (ids[at] == node))
                if not len(own):
                    continue
                at, k = at[own], mult[own]
                wt = w[own] * k
                parts = [wt * (y[own].astype(int) == c) for c in range(config.width)] if config.classification else [wt * y[own], wt * y[own] * y[own]]
                parts.append(np.ones(len(own)))
                for f in [*([-1] if whole else []), *range(p)]:
                    if exact and f >= 0:
                        g = pd.DataFrame({"at": at, "bin": rows.values[own, f], "n": k, "w": wt, **{f"s{i}": q for i, q in enumerate(parts)}})
                        g = (g[allowed[t][at, f]] if t in allowed else g).groupby(["at", "bin"], as_index=False).sum()
                        if len(g):  # a batch's values; those of all batches are summed by Spark
                            yield out(g.assign(tree_id=t, node_id=ids[g["at"]], feature=f))
                        continue
                    nb = 1 if f < 0 else n_bins[f]
                    if f >= 0 and nb <= 1:
                        continue
                    key = at if f < 0 else at * nb + rows.values[own, f]
                    got = np.stack([np.bincount(key, q, len(ids) * nb) for q in (k, wt, *parts)])
                    sums[t, f] = got if (t, f) not in sums else sums[t, f] + got
        for (t, f), got in sums.items():
            ids = asked[t]
            nb = got.shape[1] // len(ids)
            live = np.flatnonzero(got[0] > 0)
            if f >= 0 and t in allowed:
                live = live[allowed[t][live // nb, f]]
            if len(live):
                yield out({"tree_id": t, "node_id": ids[live // nb], "feature": f, "bin": live % nb, "n": got[0, live], "w": got[1, live]} | {f"s{i}": got[2 + i, live] for i in range(width)})

    schema_ = "tree_id int, node_id long, feature int, bin double, n long, w double, " + ", ".join(f"s{k} double" for k in range(width))
    return run, schema_


def _route_kernel(moves, trees: list[int], config: TreeConfig, place):
    """Rows with the node they are in, for each tree."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = Batch(batch, config, place)
            at = np.stack([rows.nodes(t, moves) for t in trees], axis=1) if batch.num_rows else np.zeros((0, len(trees)), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, max(1, len(trees))), pa.int32()), pa.array(at.ravel()))
            names = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "at"])

    return run


def _finish_kernel(moves, roots: dict[int, np.ndarray], config: TreeConfig, place):
    """(tree_id, root_id, v, y, w, m): the rows of nodes that one task finishes; v holds a row's bins or values as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Batch(batch, config, place)
            v = np.ascontiguousarray(rows.values.astype("<f8" if config.exact else "<i2"))
            size = v.itemsize * v.shape[1]
            y, w = rows.column("y"), rows.column("w")
            for t, ids in roots.items():
                mult, node = rows.multiplicity(t), rows.nodes(t, moves)
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                own = np.flatnonzero((mult > 0) & (ids[at] == node))
                if len(own):
                    raw = pa.Array.from_buffers(pa.binary(size), len(own), [None, pa.py_buffer(v[own].tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(node[own]), raw, pa.array(y[own]), pa.array(w[own]), pa.array(mult[own].astype(np.int32))], ["tree_id", "root_id", "v", "y", "w", "m"])

    return run


# --- levels ----------------------------------------------------------------


def _summed(rows: DataFrame, width: int) -> DataFrame:
    names = ["n", "w", *[f"s{k}" for k in range(width)]]
    return rows.groupBy(*split.KEYS, "bin").agg(*[F.sum(x).alias(x) for x in names])


def _with_siblings(small: DataFrame, parents: DataFrame, pairs: list[tuple[int, int, int, int]], width: int) -> DataFrame:
    """Histograms of the smaller children, and of the larger: the parents' less the smaller's. pairs: (tree, parent, smaller, larger)."""
    names = ["n", "w", *[f"s{k}" for k in range(width)]]
    p = small.sparkSession.createDataFrame(pairs, "tree_id int, parent long, smaller long, larger long")
    one = small.join(p.select("tree_id", F.col("smaller").alias("node_id"), "larger"), ["tree_id", "node_id"], "left")
    own = F.struct("node_id", *names)
    less = F.struct(F.col("larger").alias("node_id"), *[(-F.col(x)).alias(x) for x in names])
    signed = one.select("tree_id", "feature", "bin", F.inline(F.when(F.col("larger").isNull(), F.array(own)).otherwise(F.array(own, less))))
    above = parents.filter("feature >= 0").join(p.select("tree_id", F.col("parent").alias("node_id"), "larger"), ["tree_id", "node_id"]).select("tree_id", "feature", "bin", F.col("larger").alias("node_id"), *names)
    return _summed(signed.unionByName(above), width).filter("n > 0")


def _bounds(c: TreeConfig, n: Node, lsum, lw, rsum, rw):
    sign = c.monotone[n.feature] if c.monotone else 0
    if not sign or c.classification:
        return (n.lower, n.upper), (n.lower, n.upper)
    mean = lambda s, w: s[0] / w if w > 0 else 0.0
    mid = min(max((mean(lsum, lw) + mean(rsum, rw)) / 2, n.lower), n.upper)
    return ((n.lower, mid), (mid, n.upper)) if sign > 0 else ((mid, n.upper), (n.lower, mid))


class Growth:
    """One run of growth: the rows' state, the parents' histograms, and what is still open."""

    def __init__(self, data: DataFrame, config: TreeConfig, edges, n_features: int, ids: list[int]):
        self.config, self.edges, self.p, self.ids = config, edges, n_features, ids
        self.out = Trees(config, edges, n_features)
        has = [c for c in ("rank",) if c in data.columns and config.bootstrap == "rows"]
        self.state = data.select("row_id", *has, "x" if config.exact else "b", "y", "w", "m")
        self.written = False  # whether state is a generation of ours
        self.place = {t: i for i, t in enumerate(ids)}
        self.splits: dict[int, list[Node]] = {t: [] for t in ids}  # since the state was written
        self.levels = 0
        self.parents: DataFrame | None = None
        self.kept_tables: list[DataFrame] = []
        self.finishing: dict[int, list[int]] = {}
        self.cap = float("inf") if config.max_depth is None else config.max_depth
        self.subtract = config.subtract and not config.exact and (config.max_features is None or config.max_features >= n_features)

    def histogram(self, asked: dict[int, np.ndarray], depth: int) -> DataFrame:
        """(tree_id, node_id, feature, bin, n, w, s0..) of the nodes asked; feature -1 holds whole-node sums of roots."""
        c, p = self.config, self.p
        allowed = {}
        if c.max_features is not None and c.max_features < p:
            for t, ids in asked.items():
                allowed[t] = np.zeros((len(ids), p), bool)
                for i, n in enumerate(ids.tolist()):
                    allowed[t][i, feature_subset(c, p, t, n)] = True
        run, s = _level_kernel(_moves(self.splits, self.levels, c.exact), asked, allowed, depth == 0, c, self.place, p, None if c.exact else [len(e) for e in self.edges])
        return _summed(self.state.mapInArrow(run, s), c.width + 1)

    def level(self, frontier: dict[int, list[int]], group: list[int], depth: int, more: bool):
        """(histograms of the group's open nodes, whether they are a table); the larger of two open children is told from the parent."""
        asked, pairs = {}, []
        for t in group:
            own = set(frontier[t])
            if self.parents is not None:
                for i in [i for i in own if i % 2 and i + 1 in own]:
                    a, b = (i, i + 1) if self.out.nodes[t, i].samples <= self.out.nodes[t, i + 1].samples else (i + 1, i)
                    pairs.append((t, (i - 1) // 2, a, b))
                    own.discard(b)
            asked[t] = np.array(sorted(own), np.int64)
        h = self.histogram(asked, depth)
        if pairs:
            h = _with_siblings(h, self.parents, pairs, self.config.width + 1)
        return materialised(h, "histogram") if more else h

    def searched(self, h: DataFrame) -> list:
        c = self.config
        s = h.filter("feature >= 0").select(*split.KEYS, "bin", "n", "w", F.array(*[f"s{k}" for k in range(c.width + 1)]).alias("s"))
        return split.best(split.candidates(s, c.width, c.classification, c.min_samples_leaf, c.monotone, c.exact, beside=1)).collect()

    def roots(self, h: DataFrame, group: list[int], found: list) -> None:
        """The roots' nodes: from their splits, or, where one has none, from the whole-node sums."""
        for r in found:
            self.out.nodes[r["tree_id"], 0] = Node(r["tree_id"], 0, 0, r["tn"], r["tw"], list(r["ts"])[:-1])
        if len(found) < len(group):
            for r in h.filter("feature = -1").collect():
                self.out.nodes.setdefault((r["tree_id"], 0), Node(r["tree_id"], 0, 0, r["n"], r["w"], [r[f"s{k}"] for k in range(self.config.width)]))

    def split_node(self, r, depth: int, following: dict[int, list[int]]) -> None:
        c, n = self.config, self.out.nodes[r["tree_id"], r["node_id"]]
        if n.samples < c.min_samples_split:
            return
        n.feature, n.bin, n.gain = r["feature"], r["bin"], r["gain"]
        n.threshold = r["threshold"] if c.exact else self.edges[n.feature][int(n.bin)]
        self.splits[n.tree_id].append(n)
        (ll, lu), (rl, ru) = _bounds(c, n, r["ls"], r["lw"], r["rs"], r["rw"])
        for i, side, lo, hi in ((2 * n.node_id + 1, "l", ll, lu), (2 * n.node_id + 2, "r", rl, ru)):
            *sums, rows = r[f"{side}s"]
            kid = self.out.nodes[n.tree_id, i] = Node(n.tree_id, i, depth + 1, r[f"{side}n"], r[f"{side}w"], sums, lo, hi, rows=rows)
            if kid.samples >= c.min_samples_split and depth + 1 < self.cap:
                few = kid.rows <= c.finish_rows and self.cap - depth - 1 > c.finish_levels
                (self.finishing.setdefault(n.tree_id, []) if few else following[n.tree_id]).append(i)

    def written_state(self) -> None:
        """The rows with their nodes, once every ROUTE_LEVELS levels; the generation before goes."""
        run = _route_kernel(_moves(self.splits, self.levels, self.config.exact), self.ids, self.config, self.place)
        kept = [f"{f.name} {f.dataType.simpleString()}" for f in self.state.schema if f.name != "at"]
        before, was = self.state, self.written
        self.state, self.written = materialised(self.state.mapInArrow(run, ", ".join([*kept, "at array<bigint>"])), "routes"), True
        if was:
            dropped(before)
        self.splits, self.levels = {t: [] for t in self.ids}, 0

    def run(self) -> Trees:
        c = self.config
        cells = max(1, sum(len(e) for e in self.edges)) if self.edges else 256 * self.p
        frontier: dict[int, list[int]] = {t: [0] for t in self.ids}
        depth = 0
        if not c.bootstrap and self.cap > c.finish_levels and 0 < (rows := self.state.count()) <= c.finish_rows:
            frontier, self.finishing = {}, {t: [0] for t in self.ids}
            self.out.nodes = {(t, 0): Node(t, 0, 0, rows, 0.0, [0.0] * c.width) for t in self.ids}  # the finished parts have the roots themselves
        while any(frontier.values()):
            live = [t for t in self.ids if frontier[t]]
            widest = max(len(frontier[t]) for t in live)
            step = max(1, HIST_CELLS // (cells * widest * (2 + c.width)))
            following: dict[int, list[int]] = {t: [] for t in self.ids}
            more = self.subtract and depth + 1 < self.cap
            tables = []
            for at in range(0, len(live), step):
                group = live[at : at + step]
                h = self.level(frontier, group, depth, more)
                found = self.searched(h) if depth < self.cap else []
                if depth == 0:
                    self.roots(h, group, found)
                for r in found:
                    self.split_node(r, depth, following)
                tables += [h] if more else []
            if depth + 1 >= HEAP_LEVELS and any(following.values()):
                raise ValueError(f"nodes of more than finish_rows = {c.finish_rows} rows at depth {HEAP_LEVELS}: set a larger finish_rows, or max_depth")
            if len(self.out.nodes) > MAX_NODES:
                raise ValueError(f"over {MAX_NODES} nodes of more than finish_rows = {c.finish_rows} rows: set a larger finish_rows, max_depth or min_samples_leaf")
            for old in self.kept_tables:
                dropped(old)
            self.kept_tables = tables
            self.parents = None
            for h in tables:
                self.parents = h if self.parents is None else self.parents.unionByName(h)
            depth += 1
            self.levels += 1
            frontier = following if depth < self.cap else {}
            if self.levels >= ROUTE_LEVELS and any(frontier.values()):
                self.written_state()
        for old in self.kept_tables:
            dropped(old)
        if self.finishing:
            self.finish()
        if self.written:
            dropped(self.state)
        return self.out

    def finish(self) -> None:
        """Grows what is below the nodes of few rows, a task a node, and adds it to the trees."""
        c, out = self.config, self.out
        cuts = None if c.exact else [np.array(e) for e in self.edges]
        moves = _moves(self.splits, self.levels, c.exact)
        group: list[int] = []
        size = 0
        groups = [group]
        for t in sorted(self.finishing):
            draws_ = sum(out.nodes[t, i].samples for i in self.finishing[t])
            if group and size + draws_ > FINISH_DRAWS:
                groups.append(group := [])
                size = 0
            group.append(t)
            size += draws_
        for trees in groups:
            roots = {t: np.array(sorted(self.finishing[t]), np.int64) for t in trees}
            about = {(t, i): (k, out.nodes[t, i].depth, out.nodes[t, i].lower, out.nodes[t, i].upper) for t in trees for k, i in enumerate(self.finishing[t])}
            sent = self.state.sparkSession.sparkContext.broadcast(about)  # one entry for each root; the driver's nodes are bounded

            def rest(pdf):
                t, i = int(pdf["tree_id"].iloc[0]), int(pdf["root_id"].iloc[0])
                part, depth, lower, upper = sent.value[t, i]  # noqa: B023
                v = np.frombuffer(b"".join(pdf["v"]), "<f8" if c.exact else "<i2").reshape(len(pdf), -1)
                v = v if c.exact else v.astype(np.int64)
                return grow_rest(v, pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["m"].to_numpy(np.int64), c, cuts, t, i, part, depth, lower, upper, c.max_depth)

            rows = self.state.mapInArrow(_finish_kernel(moves, roots, c, self.place), "tree_id int, root_id long, v binary, y double, w double, m int")
            table = materialised(rows.groupBy("tree_id", "root_id").applyInPandas(rest, REST), "subtrees")
            counts = {(r["tree_id"], r["root_id"]): r["n"] for r in table.groupBy("tree_id", "root_id").agg(F.count("*").alias("n")).collect()}  # a row for each root
            out.attach(table, counts)


def joined_rows(data: DataFrame, config: TreeConfig) -> DataFrame:
    """data with rows of equal features, target and weight as one with their number as its count; for growth without a bootstrap, where they are never told apart."""
    x = "x" if config.exact else "b"
    same = data.groupBy(x, "y", "w").agg(F.min("row_id").alias("row_id"), F.array(F.count("*").cast("int")).alias("m"))
    return materialised(spread(same), "joined")


def spread(data: DataFrame) -> DataFrame:
    """data in as many partitions as there are cores at least, those with ranks by rank, as draws are made by blocks of ranks."""
    spark = data.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return data.repartitionByRange(parts, "rank").sortWithinPartitions("rank") if "rank" in data.columns else data.repartition(parts)


def grow(data: DataFrame, config: TreeConfig, edges: list[list[float]] | None, n_features: int, tree_ids: list[int] | None = None) -> Trees:
    """Grows config.n_trees trees (or those named) over data (row_id, x or b, y, w, m, and rank for draws in the row)."""
    ids = list(range(config.n_trees)) if tree_ids is None else tree_ids
    deep = config.max_depth is None or config.max_depth > config.finish_levels
    if config.bootstrap or not deep:
        return Growth(data, config, edges, n_features, ids).run()
    data = joined_rows(data, config)
    out = Growth(data, config, edges, n_features, ids).run()
    dropped(data)
    return out


def prepared(frame: DataFrame, config: TreeConfig, edges: list[list[float]] | None) -> DataFrame:
    """Rows ready for growth, written once: bins for histogram mode, ranks or multiplicities for a bootstrap of n draws."""
    d = frame if edges is None else assign_bins(frame, edges)
    if config.bootstrap in ("exact", "rows"):
        d = with_rank(d, ["row_id"])
    d = with_multiplicity(d, config)
    out = materialised(spread(d) if config.bootstrap == "rows" else d, "prepared")
    if config.bootstrap == "rows":
        config.rows = out.count()
    return out


__all__ = ["MAX_NODES", "Node", "TreeConfig", "Trees", "bootstrap_counts", "descend", "feature_subset", "grow", "matrix", "prepared", "row_draws", "with_multiplicity"]
