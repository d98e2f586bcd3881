"""Unsupervised forest: real rows against column-wise permuted ones, and what co-leaf counts say.

Proximities are pairs of rows that share leaves, found by an equi-join on
(tree, leaf). A leaf with g rows makes g**2 pairs, which is what a proximity
matrix is; ``max_pairs`` is checked on leaf sizes before the join and refuses,
rather than samples, where the matrix would not fit. What leaves out the bag
(scores and scaling with ``use_oob=False``, scores of new rows) needs no pairs:
see ``leafwise``. Rows with the same leaves and bags are one class, and proximities
are those of classes. With the bag, outlier scores come from counts by set of bags
or from pairs of classes, and MDS is a power iteration of Spark jobs over the pairs;
only sums go to the driver, or the matrix itself where it has at most ``MDS_DRIVER`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.scalar import draw
from copse.operators import binning, leafwise, validate
from copse.operators.grow import TreeConfig, Trees, grow, prepared
from copse.operators.score import per_tree
from copse.sources.frames import materialised, with_rank

MAX_PAIRS, MDS_DRIVER, MASK_BITS = 2_000_000_000, 1000, 62
#: Classes and rows that go to all tasks where pairs of classes are expanded to pairs of rows, and pairs that a task makes.
SENT_CLASSES, SENT_ROWS, TASK_PAIRS = 1000, 4_000_000, 20_000_000


def synthetic_union(df: DataFrame, row_id: str, features: list[str], seed: int = 0) -> DataFrame:
    """(row_id, y, features): real rows with y = 1 over rows with y = 0 whose columns are permuted each by itself."""
    real = with_rank(df.select(F.col(row_id).cast("long").alias("row_id"), *[F.col(c).cast("double").alias(c) for c in features]), ["row_id"], "r")
    real = materialised(real, "real")
    n = real.count()
    made = real.select("r")
    for f, c in enumerate(features):
        col = with_rank(real.select("row_id", c, draw(seed, F.lit("perm"), F.lit(f), F.col("row_id")).alias("h")), ["h", "row_id"], "r").select("r", c)
        made = made.join(col, "r")
    top = real.agg(F.max("row_id")).first()[0]
    out = real.select("row_id", F.lit(1.0).alias("y"), *features)
    return out.unionByName(made.select((F.col("r") + (top or 0) + 1).alias("row_id"), F.lit(0.0).alias("y"), *features)) if n else out


def co_leaf(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree_id, i, j) of rows of a and b in the same leaf."""
    return a.select("tree_id", "leaf", F.col("row_id").alias("i")).join(b.select("tree_id", "leaf", F.col("row_id").alias("j")), ["tree_id", "leaf"]).select("tree_id", "i", "j")


def check_pairs(leaves: DataFrame, most: int = MAX_PAIRS) -> None:
    n = leaves.groupBy("tree_id", "leaf").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    if n > most:
        raise ValueError(f"{n} pairs share leaves; use deeper trees or neighbours of a query set")


def proximity(leaves: DataFrame, bag: DataFrame | None = None) -> DataFrame:
    """(i, j, prox): share of trees in which i and j share a leaf.

    With bag (row_id, tree_id of rows in the bag), a tree counts for a pair
    unless both are in its bag. The diagonal is 1 for a row out of some bag.
    Proximities are worked out for pairs of classes; only what is returned has a row for each pair of rows.
    """
    return expanded(*class_pairs(leaves, bag))


def bag_classes(leaves: DataFrame, bag: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, i), and (i, n, key, mask) of classes i: rows with the same leaves in all trees and in the same bags, named by their least row_id."""
    entry = F.struct(F.col("tree_id").cast("int").alias("tree_id"), F.col("leaf").cast("long").alias("leaf"))
    own = leaves.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("key"))  # one entry per tree
    none = F.expr("cast(array() as array<bigint>)")
    own = own.withColumn("mask", none) if bag is None else own.join(bag_masks(bag), "row_id", "left").withColumn("mask", F.coalesce("mask", none))
    own = materialised(own, "keys")
    found = materialised(own.groupBy("key", "mask").agg(F.min("row_id").alias("i"), F.count("*").alias("n")), "classes")
    return materialised(own.join(found, ["key", "mask"]).select("row_id", "i"), "members"), found


def class_pairs(leaves: DataFrame, bag: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, j, prox) of classes, those of a class with itself included, and (row_id, i): two rows have the proximity of their classes, a row and itself too."""
    trees = leaves.select("tree_id").distinct().count()
    members, classes = bag_classes(leaves, bag)
    own = classes.select(F.col("i").alias("row_id"), F.explode("key").alias("_k")).select("row_id", "_k.tree_id", "_k.leaf")
    pairs = co_leaf(own, own)
    if bag is None:
        found = pairs.groupBy("i", "j").agg((F.count("*") / float(trees)).alias("prox"))
    else:
        found = _out_of_bag(pairs, classes.select(F.col("i").alias("row_id"), "mask"), trees)
        found = found.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("same") / F.col("valid")).alias("prox"))
    return materialised(found, "class-pairs"), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(i, j, prox) of rows from those of classes. Few classes go to all tasks, so no pair of rows is shuffled."""
    sizes = members.groupBy("i").agg(F.count("*").alias("n"))
    classes, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if classes == rows:
        return pairs
    left, right = members.select(F.col("row_id").alias("_l"), "i"), members.select(F.col("row_id").alias("_r"), F.col("i").alias("j"))
    if classes <= SENT_CLASSES and rows <= SENT_ROWS:
        total = pairs.join(sizes, "i").join(sizes.select(F.col("i").alias("j"), F.col("n").alias("m")), "j").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))
        left, pairs, right = left.repartition(tasks), F.broadcast(pairs), F.broadcast(right)
    return left.join(pairs, "i").join(right, "j").select(F.col("_l").alias("i"), F.col("_r").alias("j"), "prox")


def out_of_bag(pairs: DataFrame, bag: DataFrame, trees: int) -> DataFrame:
    """(i, j, same, valid): trees in whose leaf both are, and trees at all, without those that have both in the bag; same is 1 at least."""
    return _out_of_bag(pairs, bag_masks(bag), trees)


def _out_of_bag(pairs: DataFrame, masks: DataFrame, trees: int) -> DataFrame:
    own = masks.select(F.col("row_id").alias("i"), F.col("mask").alias("mi"))
    other = masks.select(F.col("row_id").alias("j"), F.col("mask").alias("mj"))
    trees_of = F.array_sort(F.collect_list(F.col("tree_id").cast("int"))).alias("shared")
    same = pairs.groupBy("i", "j").agg(trees_of).join(own, "i", "left").join(other, "j", "left")  # trees by pair: at most the number of trees
    none = F.expr("cast(array() as array<bigint>)")
    same = same.select("i", "j", "shared", _both(F.coalesce("mi", none), F.coalesce("mj", none)).alias("both"))
    out = F.size(F.filter("shared", lambda t: ~_has("both", t)))
    inbag = F.aggregate("both", F.lit(0), lambda s, x: s + F.bit_count(x))
    return same.select("i", "j", out.alias("same"), (F.lit(trees) - inbag).alias("valid")).filter("same > 0")


def _both(a, b):
    """The trees in both of two masks."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0).cast("long")))


def _has(mask, tree):
    """Whether a mask has a tree."""
    return F.coalesce(F.getbit(F.get(mask, F.floor(tree / MASK_BITS).cast("int")), tree % MASK_BITS), F.lit(0)) == 1


def bagged_squares(leaves: DataFrame, bag: DataFrame, trees: int) -> DataFrame:
    """(row_id, s): the sum of a row's squared proximities with the bag, itself included; by pairs of classes or by pairs of trees and bags, whichever are fewer by count.

    The divisor of a pair depends on the two rows' bags only. So where few
    different sets of bags occur, the rows of each in a cell (a leaf of one tree,
    a leaf of another) are counted, and for each set of bags the counts of all
    sets are added up, each over its divisor squared, without the trees that have
    both in the bag.
    """
    members, classes = bag_classes(leaves, bag)
    own = classes.select(F.col("i").alias("row_id"), F.explode("key").alias("_k")).select("row_id", "_k.tree_id", "_k.leaf")
    pairs, entries = leafwise.costs(own)
    sets = materialised(classes.select("mask").distinct().withColumn("set", F.monotonically_increasing_id()), "bags")
    if sets.count() * entries < pairs:
        found = _squares_of_sets(classes.join(sets, "mask"), sets, trees)
    else:
        check_pairs(own)
        found = _out_of_bag(co_leaf(own, own), classes.select(F.col("i").alias("row_id"), "mask"), trees).join(classes.select(F.col("i").alias("j"), "n"), "j")
        prox = F.col("same") / F.col("valid")
        found = found.groupBy("i").agg(F.sum(prox * prox * F.col("n")).alias("s"))
    return members.join(found, "i", "left").select("row_id", F.coalesce("s", F.lit(0.0)).alias("s"))


def _squares_of_sets(classes: DataFrame, sets: DataFrame, trees: int) -> DataFrame:
    """(i, s) per class, from counts by cell and set of bags."""
    first = classes.select("i", "n", "set", "key", F.posexplode("key").alias("at", "a"))
    cells = first.select("i", "n", "set", "a", F.explode(F.slice("key", F.col("at") + 1, F.size("key"))).alias("b"))
    cells = materialised(cells.select("i", "n", "set", F.col("a.tree_id").alias("t"), F.col("a.leaf").alias("tl"), F.col("b.tree_id").alias("u"), F.col("b.leaf").alias("ul")), "cells")
    keys = ["t", "tl", "u", "ul"]
    counts = cells.groupBy("set", *keys).agg(F.sum("n").alias("n"))
    two = sets.select(F.col("set").alias("own"), F.col("mask").alias("mi")).crossJoin(sets.select("set", F.col("mask").alias("mj")))
    two = two.select("own", "set", _both(F.col("mi"), F.col("mj")).alias("both"))
    valid = F.lit(trees) - F.aggregate("both", F.lit(0), lambda s, x: s + F.bit_count(x))
    two = two.withColumn("valid", valid).filter("valid > 0").select("own", "set", "both", (1.0 / (F.col("valid") * F.col("valid"))).alias("share"))
    times = F.when((F.col("t") == F.col("u")) & (F.col("tl") == F.col("ul")), 1).otherwise(2)
    met = counts.join(two, "set").filter(~_has("both", F.col("t")) & ~_has("both", F.col("u")))
    sums = met.groupBy("own", *keys).agg(F.sum(F.col("n") * times * F.col("share")).alias("s"))
    return cells.withColumnRenamed("set", "own").join(sums, ["own", *keys]).groupBy("i").agg(F.sum("s").alias("s"))


def bag_masks(bag: DataFrame) -> DataFrame:
    """(row_id, mask): the trees of a row's bag as bits of an array of longs."""
    words = bag.groupBy("row_id", F.floor(F.col("tree_id") / MASK_BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(tree_id % {MASK_BITS} as int))")).alias("bits"))
    m = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # a row's own words
    rows = words.groupBy("row_id").agg(m.alias("words"), F.max("word").alias("last"))
    return rows.select("row_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.element_at("words", k), F.lit(0).cast("long"))).alias("mask"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, prox, rank): the k largest proximities of each row to others, exact; ties by j."""
    w = Window.partitionBy("i").orderBy(F.col("prox").desc(), "j")
    return pairs.filter("i <> j").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_squares(pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, s): the sum of squared proximities of a row, itself included; 0 for rows (row_id) that are in no pair."""
    s = pairs.groupBy("i").agg(F.sum(F.col("prox") * F.col("prox")).alias("s")).withColumnRenamed("i", "row_id")
    return s if rows is None else rows.select("row_id").join(s, "row_id", "left").fillna(0.0, ["s"])


def outlier_scores(squares: DataFrame, n: int) -> DataFrame:
    """(row_id, score): n over a row's sum s of squared proximities (0 where that is 0), centred at the upper median, scaled, 20 at most."""
    raw = squares.select("row_id", F.when(F.col("s") > 0, F.lit(float(n)) / F.col("s")).otherwise(F.lit(0.0)).alias("raw"))
    raw = materialised(raw, "outliers")
    m = raw.count()
    med = with_rank(raw, ["raw"], "k").filter(F.col("k") == m // 2).agg(F.max("raw").alias("med"))
    raw = raw.join(F.broadcast(med))  # one row
    mad = raw.agg(F.avg(F.least(F.abs(F.col("raw") - F.col("med")), 5 * F.col("med"))).alias("mad"))
    raw = raw.join(F.broadcast(mad.select(F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.lit(1.0)).alias("mad"))))  # one row
    return raw.select("row_id", F.least((F.col("raw") - F.col("med")) / F.col("mad"), F.lit(20.0)).alias("score"))


def outlier_new(squares: DataFrame, n_train: int) -> DataFrame:
    """(row_id, score) of new rows from their sums of squared proximities to training rows: min(n / s, 20)."""
    return squares.select("row_id", F.when(F.col("s") > 0, F.least(F.lit(float(n_train)) / F.col("s"), F.lit(20.0))).otherwise(F.lit(20.0)).alias("score"))


def squares(leaves: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(row_id, s) without the bag, by pairs of rows or by pairs of trees, whichever are fewer by count."""
    pairs, cells = leafwise.costs(leaves, train)
    if cells < pairs:
        return leafwise.squares(leaves, train)
    trees = leafwise.tree_count(leaves if train is None else train)
    found = co_leaf(leaves, leaves if train is None else train).groupBy("i", "j").agg((F.count("*") / float(trees)).alias("prox"))
    return pair_squares(found, leaves.select("row_id").distinct())


def leaf_classes(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, i), and (tree_id, row_id, leaf) of classes i: rows with the same leaves in all trees, named by their least row_id."""
    members, found = leafwise.leaf_classes(leaves)
    return members, found.select(F.col("i").alias("row_id"), F.explode("key").alias("_k")).select("row_id", "_k.tree_id", "_k.leaf")


def mds(pairs: DataFrame, n_components: int = 2, compat: bool = False, iterations: int = 1000, members: DataFrame | None = None, on_driver: int = MDS_DRIVER) -> DataFrame:
    """(row_id, c0, c1, ...): classical scaling of a proximity matrix by power iteration.

    With members (row_id, i), pairs are of classes i whose rows have equal
    proximities. Matrices of more than on_driver rows stay in Spark.
    compat deflates with scaled vectors, which repeats the first component when its eigenvalue is large.
    """
    spark = pairs.sparkSession
    pairs = materialised(pairs.select("i", "j", F.col("prox").cast("double").alias("prox")), "pairs")
    if members is None:
        members = pairs.select(F.col("i").alias("row_id"), "i").distinct()
    members = materialised(members, "members")
    # n rows of a class and s, the sum of its rows' entries of the first vector, which alternates by row_id
    sums = with_rank(members, ["row_id"], "r").groupBy("i").agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("r") % 2 == 0, 1.0).otherwise(-1.0)).alias("s"))
    sums = materialised(sums, "sums")
    k = sums.count()
    cs = [f"c{c}" for c in range(n_components)]
    if k <= on_driver:
        coords = _mds_local(sums.orderBy("i").collect(), pairs.collect(), n_components, compat, iterations)
        found = spark.createDataFrame(coords, "i long, " + ", ".join(f"{c} double" for c in cs))
    else:
        found = _mds_jobs(sums, pairs, n_components, compat, iterations)
    return members.join(found, "i").select("row_id", *cs)


def _mds_local(sums: list, pairs: list, n_components: int, compat: bool, iterations: int) -> list[tuple]:
    at = {r["i"]: x for x, r in enumerate(sums)}
    n, s0 = np.array([r["n"] for r in sums]), np.array([r["s"] for r in sums])
    a = np.zeros((len(at), len(at)))
    for r in pairs:
        a[at[r["i"]], at[r["j"]]] = r["prox"]
    mean = a @ n / max(n.sum(), 1)
    b = 0.5 * (a - mean - mean[:, None] + (mean @ n) / max(n.sum(), 1))
    coords = np.zeros((len(at), n_components))
    for c in range(n_components):
        s, u, lam = s0 / max(np.sqrt(n.sum()), 1e-300), np.zeros(len(at)), 0.0  # the first vector isn't constant in a class
        for _ in range(iterations):
            v = b @ s
            lam, vv = float(s @ v), float(n @ (v * v))
            if vv - lam * lam < lam * lam * 1e-14 or not vv:
                break
            u = v / np.sqrt(vv)
            s = n * u
        coords[:, c] = u * np.sqrt(abs(lam))
        w = coords[:, c] if compat else u
        b = b - lam * np.outer(w, w)
    return [(i, *map(float, x)) for i, x in zip(at, coords, strict=True)]


def _mds_jobs(sums: DataFrame, pairs: DataFrame, n_components: int, compat: bool, iterations: int) -> DataFrame:
    """The same with the vector as a table; the driver sees sums over it."""
    total = sums.agg(F.sum("n")).first()[0]
    mean = pairs.join(sums.select(F.col("i").alias("j"), "n"), "j").groupBy("i").agg((F.sum(F.col("prox") * F.col("n")) / total).alias("mean"))
    base = materialised(sums.withColumnRenamed("s", "s0").join(mean, "i", "left").fillna(0.0, ["mean"]), "base")
    grand = base.agg(F.sum(F.col("mean") * F.col("n"))).first()[0] / total
    lams: list[float] = []
    for c in range(n_components):
        old = [f"w{x}" for x in range(c)]
        vec, lam = base.withColumn("s", F.col("s0") / float(np.sqrt(total))).withColumn("u", F.lit(0.0)), 0.0
        for _ in range(iterations):
            d = vec.agg(F.sum("s").alias("one"), F.sum(F.col("s") * F.col("mean")).alias("mean"), *[F.sum(F.col("s") * F.col(w)).alias(w) for w in old]).first()
            prod = pairs.join(vec.select(F.col("i").alias("j"), "s"), "j").groupBy("i").agg(F.sum(F.col("prox") * F.col("s")).alias("p"))
            v = 0.5 * (F.coalesce("p", F.lit(0.0)) - d["mean"] + (grand - F.col("mean")) * d["one"])
            for x, w in enumerate(old):
                v = v - F.col(w) * (lams[x] * d[w])
            step = materialised(vec.join(prod, "i", "left").withColumn("v", v).drop("p"), "step")
            lam, vv = step.agg(F.sum(F.col("s") * F.col("v")), F.sum(F.col("n") * F.col("v") * F.col("v"))).first()
            if vv - lam * lam < lam * lam * 1e-14 or not vv:
                vec = step
                break
            vec = step.withColumn("u", F.col("v") / float(np.sqrt(vv))).withColumn("s", F.col("n") * F.col("u")).drop("v")
        coord = F.col("u") * float(np.sqrt(abs(lam)))
        base = materialised(vec.select(*base.columns, coord.alias(f"c{c}"), (coord if compat else F.col("u")).alias(f"w{c}")), "base")
        lams.append(lam)
    return base.select("i", *[f"c{c}" for c in range(n_components)])


@dataclass
class UnsupervisedModel:
    trees: Trees
    features: list[str]
    n_samples_: int
    train: DataFrame  # (row_id, x) real rows
    bag: DataFrame  # (row_id, tree_id) of real rows drawn
    n_neighbors: int = 10

    @property
    def n_estimators_(self) -> int:
        return self.trees.config.n_trees

    @property
    def is_fitted_(self) -> bool:
        return bool(self.trees.nodes)

    @property
    def n_features_(self) -> int:
        return len(self.features)

    def leaves(self, df: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
        d = self.train if df is None else df.select(F.col(row_id).cast("long").alias("row_id"), F.array(*[F.col(c).cast("double") for c in self.features]).alias("x"))
        return per_tree(d, self.trees)

    def proximity_matrix(self, use_oob: bool = True) -> DataFrame:
        own = materialised(self.leaves(), "leaves")
        check_pairs(own)
        return proximity(own, self.bag if use_oob else None)

    def proximity_sparse(self, k: int | None = None, use_oob: bool = True) -> DataFrame:
        """Out-of-bag co-leaf counts over all trees, the k (else n_neighbors) largest of each row; without the bag, no table of pairs is made."""
        k = self.n_neighbors if k is None else k
        if not use_oob:
            return leafwise.nearest(self.leaves(), min(max(k, 1), max(self.n_samples_ - 1, 1)))
        own = materialised(self.leaves(), "leaves")
        check_pairs(own)
        trees = self.trees.config.n_trees
        found = out_of_bag(co_leaf(own, own).filter("i <> j"), self.bag, trees)
        counts = found.select("i", "j", (F.col("same") / float(trees)).alias("prox"))
        return nearest(counts, min(max(k, 1), self.n_samples_ - 1))

    def outlier_scores(self, use_oob: bool = True) -> DataFrame:
        """Without the bag (use_oob=False) at any size; with it, from pairs of trees and sets of bags where those are few, else from pairs of classes."""
        if use_oob:
            found = bagged_squares(materialised(self.leaves(), "leaves"), self.bag, self.trees.config.n_trees)
        else:
            found = squares(materialised(self.leaves(), "leaves"))
        return outlier_scores(found, self.n_samples_)

    def predict_proximity(self, df: DataFrame, row_id: str) -> DataFrame:
        trees = self.trees.config.n_trees
        return co_leaf(self.leaves(df, row_id), self.leaves()).groupBy("i", "j").agg((F.count("*") / float(trees)).alias("prox"))

    def predict_outlier_scores(self, df: DataFrame, row_id: str) -> DataFrame:
        """All new rows, those that share no leaf included."""
        new, own = materialised(self.leaves(df, row_id), "new"), materialised(self.leaves(), "leaves")
        return outlier_new(squares(new, own), self.n_samples_)

    def transform(self, n_components: int = 2, compat: bool = False, use_oob: bool = True) -> DataFrame:
        """Scaling; without the bag (use_oob=False) no table of pairs is made."""
        if use_oob or compat:
            return mds(self.proximity_matrix(use_oob), n_components, compat)
        return leafwise.scaling(self.leaves(), n_components)

    def feature_importances(self, seed: int = 0) -> list[float]:
        """Loss of out-of-bag accuracy on real rows when a column is permuted, clipped at zero and normalised."""
        def accuracy(frame: DataFrame) -> float:
            out = per_tree(frame, self.trees).join(self.bag.withColumn("inb", F.lit(1)), ["row_id", "tree_id"], "left").filter("inb is null")
            return out.agg(F.avg((F.col("value") == 1).cast("double"))).first()[0] or 0.0

        base, drops = accuracy(self.train), []
        ranked = materialised(with_rank(self.train, ["row_id"], "r"), "ranked")
        for f in range(len(self.features)):
            moved = with_rank(ranked.select("row_id", F.col("x")[f].alias("v"), draw(seed, F.lit("imp"), F.lit(f), F.col("row_id")).alias("h")), ["h", "row_id"], "r").select("r", "v")
            swapped = ranked.join(moved, "r").select("row_id", F.transform("x", lambda x, i: F.when(i == f, F.col("v")).otherwise(x)).alias("x"))  # noqa: B023
            drops.append(base - accuracy(swapped))
        clipped = [max(0.0, d) for d in drops]
        s = sum(clipped)
        return [d / s for d in clipped] if s > 0 else drops


@dataclass
class UnsupervisedForest:
    n_estimators: int = 500
    max_depth: int | None = None
    max_features: str | float | None = None
    random_state: int = 0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    n_neighbors: int = 10

    def fit_transform(self, df: DataFrame, features: list[str], row_id: str, n_components: int = 2) -> DataFrame:
        return self.fit(df, features, row_id).transform(n_components)

    def fit(self, df: DataFrame, features: list[str], row_id: str) -> UnsupervisedModel:
        both = materialised(synthetic_union(df, row_id, features, self.random_state), "union")
        frame = both.select("row_id", F.array(*features).alias("x"), "y", F.lit(1.0).alias("w"))
        config = TreeConfig(True, 2, self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf, validate.max_features(self.max_features, len(features)), bootstrap="exact", seed=self.random_state)
        edges = binning.edge_lists(binning.bin_edges(frame))
        data = prepared(frame, config, edges)
        trees = grow(data, config, edges, len(features))
        bag = data.filter("y = 1").select("row_id", F.posexplode("m").alias("tree_id", "m")).filter("m > 0").select("row_id", "tree_id")
        train = data.filter("y = 1").select("row_id", "x")
        return UnsupervisedModel(trees, features, train.count(), train, bag, self.n_neighbors)
