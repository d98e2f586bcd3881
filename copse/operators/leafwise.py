"""Outlier scores, scaling and nearest rows from leaves alone, without a table of pairs of rows.

Without the bag, the proximity of two rows is the share of the trees in whose
leaf both are. Hence, with T trees,

- T**2 times the sum of a row's squared proximities is the sum, over ordered
  pairs of trees, of the number of rows in both of its leaves. Those are counts
  of cells (a leaf of one tree, a leaf of another): n * T * (T + 1) / 2 entries
  at most, whatever the leaves' sizes.
- T times the matrix times a vector is, for each row, the sum over trees of the
  vector's sum over the row's leaf: n * T entries for each product.
- A row that shares none of another's r rarest leaves shares at most T - r. So
  the k nearest are known once k rows share more than that, and the large leaves
  are looked into only for rows that need them.

Rows with the same leaves in all trees are one class with a count. All entries
are made row by row and combined map-side; a cell or leaf that holds a large
share of all rows is joined in ``SALTS`` parts. The driver sees sums of a few
columns, or the classes themselves where there are at most ``MDS_DRIVER``.

Defined cases: a table without rows gives no rows; a row without an entry for
some tree shares no leaf there; rows that repeat count each; equal eigenvalues
leave the axes within their space open, and an eigenvalue of zero is a column
of zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.scalar import draw
from copse.sources.frames import dropped, materialised, with_rank

SALTS, MDS_DRIVER, SPARE, MAX_PAIRS = 32, 1000, 8, 2_000_000_000


def leaf_classes(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, i) and (i, n, key) of classes i: rows with the same leaves in all trees, named by their least row_id; key lists the leaves by tree."""
    own = leaves.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("tree_id").cast("int").alias("tree_id"), F.col("leaf").cast("long").alias("leaf")))).alias("key"))  # one entry per tree
    own = materialised(own, "keys")
    found = materialised(own.groupBy("key").agg(F.min("row_id").alias("i"), F.count("*").alias("n")), "classes")
    return own.join(found, "key").select("row_id", "i"), found.select("i", "n", "key")


def tree_count(leaves: DataFrame) -> int:
    return leaves.select("tree_id").distinct().count()


def _salt() -> Column:
    return F.pmod(F.hash("i"), F.lit(SALTS)).alias("salt")


def cells(classes: DataFrame) -> DataFrame:
    """(i, n, a, b, times, salt): each unordered pair of trees of each class, with its two leaves and how often the pair counts."""
    first = classes.select("i", "n", "key", F.posexplode("key").alias("at", "a"))
    both = first.select("i", "n", "a", F.explode(F.slice("key", F.col("at") + 1, F.size("key"))).alias("b"))
    return both.select("i", "n", "a", "b", F.when(F.col("a") == F.col("b"), 1).otherwise(2).alias("times"), _salt())


def shared_squares(classes: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(i, shared): per class, the trees shared with each row of train (else of the classes themselves), squared and summed."""
    asked = cells(classes)
    if train is None:
        counted = asked.groupBy("a", "b").agg(F.sum("n").alias("rows"), F.collect_set("salt").alias("salts"))  # SALTS values at most
    else:
        wanted = asked.groupBy("a", "b").agg(F.collect_set("salt").alias("salts"))
        counted = cells(train).groupBy("a", "b").agg(F.sum("n").alias("rows")).join(wanted, ["a", "b"])
    parts = counted.select("a", "b", "rows", F.explode("salts").alias("salt"))
    found = asked.join(parts, ["a", "b", "salt"], "left")
    return found.groupBy("i").agg(F.sum(F.col("times") * F.coalesce("rows", F.lit(0))).alias("shared"))


def costs(leaves: DataFrame, train: DataFrame | None = None) -> tuple[int, int]:
    """(pairs of rows in leaves, pairs of trees over rows): what the two ways to a sum of squares go through."""
    size = leaves.groupBy("tree_id", "leaf").agg(F.count("*").alias("n"))
    other = size if train is None else train.groupBy("tree_id", "leaf").agg(F.count("*").alias("n"))
    pairs = size.join(other.withColumnRenamed("n", "m"), ["tree_id", "leaf"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    both = leaves if train is None else leaves.unionByName(train)
    entries = both.groupBy("row_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") + 1) / 2), F.lit(0))).first()[0]
    return int(pairs), int(entries)


def squares(leaves: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(row_id, s): the sum of a row's squared proximities to the rows of train (else to all rows, itself included)."""
    of_train = leaves if train is None else train
    trees = tree_count(of_train)
    members, classes = leaf_classes(leaves)
    found = shared_squares(classes, None if train is None else leaf_classes(train)[1])
    return members.join(found, "i").select("row_id", (F.col("shared") / float(max(trees, 1) ** 2)).alias("s"))


def nearest(leaves: DataFrame, k: int, start: int = 2, most: int = MAX_PAIRS) -> DataFrame:
    """(i, j, prox, rank): the k largest proximities of each row to others, exact; ties by j; rows that share no leaf are no neighbours.

    Candidates of a class are the classes in its rarest leaves, of which a round
    takes twice as many; a class leaves once k + 1 rows share more trees with it than
    any class not yet met can. A class is represented by its k + 1 least row_ids.
    A round whose leaves hold more than ``most`` pairs of classes is refused.
    The result's ``pairs_examined`` counts the pairs compared.
    """
    leaves = materialised(leaves.select("row_id", "tree_id", "leaf"), "leaves")
    trees = tree_count(leaves)
    members, classes = leaf_classes(leaves)
    ids = F.array_sort(F.collect_list("row_id"))
    least = members.withColumn("part", F.pmod(F.hash("row_id"), F.lit(SALTS)))  # the least of each part first: no list of all rows of a class
    order = Window.partitionBy("i", "part").orderBy("row_id")
    least = least.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).groupBy("i").agg(F.slice(ids, 1, k + 1).alias("ids"))
    entries = classes.select("i", F.explode("key").alias("at"))
    sizes = entries.groupBy("at").agg(F.count("*").alias("size"))
    ranked = entries.join(sizes, "at").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("size", "at"))).alias("rare"))  # one entry per tree
    classes = materialised(classes.select("i", "key").join(least, "i").join(ranked, "i"), "classes")
    all_entries = classes.select(F.col("i").alias("d"), F.explode("key").alias("at"))
    other = classes.select(F.col("i").alias("d"), F.col("key").alias("other"), "ids")
    active, best, done, seen, depth, examined = classes.select("i"), None, [], 0, min(start, trees), 0
    while True:
        own = classes.join(active, "i").select("i", F.explode(F.slice("rare", seen + 1, depth - seen)).alias("r")).select("i", F.col("r.size").alias("size"), F.col("r.at").alias("at"))
        asked = int(own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        if asked > most:
            raise ValueError(f"{asked} pairs of classes share leaves; use deeper trees or fewer neighbours")
        pairs = own.join(all_entries, "at").select("i", "d").distinct()
        shared = F.size(F.array_intersect("key", "other")).alias("shared")
        counted = materialised(pairs.join(classes.select("i", "key"), "i").join(other, "d").select("i", shared, "ids"), "pairs")
        examined += counted.count()
        rows = counted.select("i", "shared", F.explode("ids").alias("j"))
        if best is not None:
            rows = rows.unionByName(best.join(active, "i", "left_semi"))
        rows = rows.dropDuplicates(["i", "j"]).withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.col("shared").desc(), "j")))
        found = materialised(rows.filter(F.col("_r") <= k + 1).drop("_r"), "best")
        dropped(counted)
        if depth >= trees:
            done.append(found)
            break
        sure = found.groupBy("i").agg(F.count("*").alias("n"), F.min("shared").alias("least")).filter((F.col("n") > k) & (F.col("least") > trees - depth)).select("i")
        done.append(found.join(sure, "i", "left_semi"))
        active, best = materialised(active.join(sure, "i", "left_anti"), "active"), found
        if active.isEmpty():
            break
        seen, depth = depth, min(2 * depth, trees)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    near = out.groupBy("i").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("less"), "j"))).alias("near"))  # k + 1 entries
    rows = members.join(near, "i").select("row_id", F.posexplode(F.slice(F.filter("near", lambda x: x["j"] != F.col("row_id")), 1, k)).alias("at", "x"))
    result = rows.select(F.col("row_id").alias("i"), F.col("x.j").alias("j"), (-F.col("x.less") / float(max(trees, 1))).alias("prox"), (F.col("at") + 1).alias("rank"))
    result.pairs_examined = examined
    return result


def times_matrix(classes: DataFrame, values: DataFrame, cols: list[str], trees: int) -> DataFrame:
    """(i, cols): the proximity matrix times columns of values (i, cols), which hold one value for all rows of a class."""
    own = classes.join(values, "i").select("n", F.explode("key").alias("leaf"), *cols, _salt())
    sums = own.groupBy("leaf").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in cols], F.collect_set("salt").alias("salts"))
    parts = sums.select("leaf", *cols, F.explode("salts").alias("salt"))
    entries = classes.select("i", F.explode("key").alias("leaf"), _salt())
    return entries.join(parts, ["leaf", "salt"]).groupBy("i").agg(*[(F.sum(c) / float(trees)).alias(c) for c in cols])


def scaling(leaves: DataFrame, n_components: int = 2, iterations: int = 300, on_driver: int = MDS_DRIVER) -> DataFrame:
    """(row_id, c0, c1, ...): classical scaling of the proximities of all rows.

    A block of n_components + ``SPARE`` vectors is multiplied at once and
    turned to its Ritz vectors, until the wanted ones are eigenvectors to 1e-7
    of their eigenvalue, or for ``iterations`` rounds. The first vector alternates
    by row_id, and a component's sign is such that it agrees with that one.
    """
    spark = leaves.sparkSession
    cs = [f"c{c}" for c in range(n_components)]
    leaves = materialised(leaves.select("row_id", "tree_id", "leaf"), "leaves")
    trees = tree_count(leaves)
    members, classes = leaf_classes(leaves)
    members = materialised(members, "members")
    first = with_rank(members, ["row_id"], "r").groupBy("i").agg(F.sum(F.when(F.col("r") % 2 == 0, 1.0).otherwise(-1.0)).alias("s"))
    classes = materialised(classes.join(first, "i"), "classes")
    if classes.count() <= max(on_driver, 1):
        coords = _local(classes.orderBy("i").collect(), n_components, trees)
        found = spark.createDataFrame(coords, "i long, " + ", ".join(f"{c} double" for c in cs))
    else:
        found = _blocks(classes, n_components, trees, iterations)
    return members.join(found, "i").select("row_id", *cs)


def _local(classes: list, n_components: int, trees: int) -> list[tuple]:
    """The same from the matrix of the classes, weighted by their rows."""
    k = len(classes)
    if not k:
        return []
    n, s = np.array([r["n"] for r in classes], float), np.array([r["s"] for r in classes])
    at = {t: x for x, t in enumerate(sorted({e["tree_id"] for r in classes for e in r["key"]}))}
    leaf, has = np.zeros((k, trees), np.int64), np.zeros((k, trees), bool)
    for x, r in enumerate(classes):
        for e in r["key"]:
            leaf[x, at[e["tree_id"]]], has[x, at[e["tree_id"]]] = e["leaf"], True
    a = np.zeros((k, k))
    for t in range(trees):
        a += (leaf[:, t, None] == leaf[None, :, t]) & has[:, t, None] & has[None, :, t]
    a /= trees
    mean = a @ n / n.sum()
    b = 0.5 * (a - mean - mean[:, None] + mean @ n / n.sum())
    root = np.sqrt(n)
    lam, u = np.linalg.eigh(root[:, None] * b * root)
    out = np.zeros((k, n_components))
    for c in range(min(n_components, k)):
        x = -1 - c
        v = u[:, x] / root
        if lam[x] > 1e-12 * n.sum():
            out[:, c] = v * np.sqrt(lam[x]) * (-1.0 if v @ s < 0 else 1.0)
    return [(r["i"], *map(float, v)) for r, v in zip(classes, out, strict=True)]


def _blocks(classes: DataFrame, n_components: int, trees: int, iterations: int) -> DataFrame:
    """Block iteration: the vectors are a table (i, v0, ...), the driver sees sums of their products."""
    width = n_components + SPARE
    total = float(classes.agg(F.sum("n")).first()[0])
    start = [F.col("s") / F.col("n")] + [draw(0, F.lit("block"), F.lit(c), F.col("i")) / float(2**60) - 0.5 for c in range(1, width)]
    values = materialised(classes.select("i", *[x.alias(f"y{c}") for c, x in enumerate(start)]), "block")
    turn = _orthonormal(classes, values, width, total)
    for _ in range(max(1, iterations)):
        k = turn.shape[1] - 1  # the last column of turn is the mean of each y
        vs = [f"v{c}" for c in range(k)]
        centred = [F.col(f"y{c}") - float(turn[c, -1]) for c in range(len(turn))]
        block = materialised(values.select("i", *[_combined(centred, turn[:, c]).alias(v) for c, v in enumerate(vs)]), "vectors")
        dropped(values)
        product = times_matrix(classes.select("i", "n", "key"), block, vs, trees)
        product = product.select("i", *[(0.5 * F.col(v)).alias(f"y{c}") for c, v in enumerate(vs)])
        values = materialised(block.join(product, "i"), "product")
        dropped(block)
        rayleigh, gram, mean, sign = _products(classes, values, k, total)
        lam, q = np.linalg.eigh((rayleigh + rayleigh.T) / 2)
        lam, q = lam[::-1], q[:, ::-1]
        wanted = lam[:n_components] > 1e-12 * total
        miss = np.einsum("ac,ab,bc->c", q, gram, q)[:n_components] - lam[:n_components] ** 2
        if (miss[wanted] <= 1e-14 * lam[:n_components][wanted] ** 2).all():
            break
        turn = _turned(gram, q, lam, mean)
    cols = []
    for c in range(n_components):
        if c < k and lam[c] > 1e-12 * total:
            weight = q[:, c] * np.sqrt(lam[c]) * (-1.0 if q[:, c] @ sign < 0 else 1.0)
            cols.append(_combined([F.col(v) for v in vs], weight).alias(f"c{c}"))
        else:
            cols.append(F.lit(0.0).alias(f"c{c}"))
    return values.select("i", *cols)


def _combined(cols: list[Column], weights) -> Column:
    out = F.lit(0.0)
    for x, w in zip(cols, weights, strict=True):
        out = out + x * float(w)
    return out


def _products(classes: DataFrame, values: DataFrame, k: int, total: float):
    """V'NY, Y'NY about the mean, the means of Y, and the first vector's products with V; sums of k * k columns."""
    d = classes.select("i", "n", "s").join(values, "i")
    n = F.col("n")
    upper = [(a, b) for a in range(k) for b in range(a, k)]
    sums = d.agg(
        *[F.sum(n * F.col(f"v{a}") * F.col(f"y{b}")) for a in range(k) for b in range(k)],
        *[F.sum(n * F.col(f"y{a}") * F.col(f"y{b}")) for a, b in upper],
        *[F.sum(n * F.col(f"y{a}")) for a in range(k)],
        *[F.sum(F.col("s") * F.col(f"v{a}")) for a in range(k)],
    ).first()
    at = np.array(sums, float)
    gram, mean = np.zeros((k, k)), at[k * k + len(upper) :][:k] / total
    for (a, b), x in zip(upper, at[k * k :], strict=False):
        gram[a, b] = gram[b, a] = x
    return at[: k * k].reshape(k, k), gram - total * np.outer(mean, mean), mean, at[-k:]


def _orthonormal(classes: DataFrame, values: DataFrame, k: int, total: float) -> np.ndarray:
    """The turn of the first block."""
    d = classes.select("i", "n").join(values, "i")
    upper = [(a, b) for a in range(k) for b in range(a, k)]
    sums = d.agg(*[F.sum(F.col("n") * F.col(f"y{a}") * F.col(f"y{b}")) for a, b in upper], *[F.sum(F.col("n") * F.col(f"y{a}")) for a in range(k)]).first()
    mean, gram = np.array(sums[len(upper) :], float) / total, np.zeros((k, k))
    for (a, b), x in zip(upper, sums, strict=False):
        gram[a, b] = gram[b, a] = x
    return _turned(gram - total * np.outer(mean, mean), np.eye(k), np.ones(k), mean)


def _turned(gram: np.ndarray, q: np.ndarray, lam: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weights that make the turned block orthonormal, without directions that vanish; the means as a last column."""
    keep = lam > 1e-12 * max(lam[0], 1e-300)
    q = q[:, keep]
    size = np.sqrt(np.maximum(np.einsum("ac,ab,bc->c", q, gram, q), 1e-300))
    q = q / size
    d, e = np.linalg.eigh(q.T @ gram @ q)
    good = d > 1e-10
    turn = q @ (e[:, good] / np.sqrt(d[good]))
    return np.column_stack([turn, mean])
