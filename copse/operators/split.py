"""Split search as DataFrame steps: histograms, prefix sums over bins, gains, best split.

A histogram table has (tree_id, node_id, feature, bin, n, w, s) where s holds
per-bin sums: weights by class (classification) or [sum wy, sum wyy]
(regression). In exact mode ``bin`` is the value itself and a split's threshold
is the midpoint to the node's next value. Empty bins are left out; that gives
the same split as a dense scan, since an empty bin repeats the gain before it
and the earlier bin wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.scalar import gini, variance
from copse.sources.frames import materialised

KEYS = ["tree_id", "node_id", "feature"]


def class_sums(y: Column, w: Column, n_classes: int) -> Column:
    return F.array(*[F.when(y.cast("int") == k, w).otherwise(F.lit(0.0)) for k in range(n_classes)])


def moment_sums(y: Column, w: Column) -> Column:
    return F.array(w * y, w * y * y)


def histogram(rows: DataFrame, per_row: Column, width: int) -> DataFrame:
    """Sums by (tree_id, node_id, feature, bin) of rows (tree_id, node_id, b array, m, w, y)."""
    long = rows.select("tree_id", "node_id", F.col("m").cast("long").alias("m"), (F.col("w") * F.col("m")).alias("w"), per_row.alias("s"), F.posexplode("b").alias("feature", "bin"))
    sums = [F.sum(F.col("s")[k] * F.col("m")).alias(f"s{k}") for k in range(width)]
    out = long.groupBy(*KEYS, "bin").agg(F.sum("m").alias("n"), F.sum("w").alias("w"), *sums)
    return out.select(*KEYS, F.col("bin").cast("double").alias("bin"), "n", "w", F.array(*[f"s{k}" for k in range(width)]).alias("s"))


def _sums_of_bins(flat: DataFrame, names: list[str]) -> DataFrame:
    """Adds threshold, sums up to each bin (l) and over the node (t): a window of as many rows as a feature has bins."""
    whole = Window.partitionBy(*KEYS)
    by_bin = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = flat.withColumn("threshold", F.col("bin"))
    return c.select("*", *[F.sum(x).over(by_bin).alias(f"l{x}") for x in names], *[F.sum(x).over(whole).alias(f"t{x}") for x in names])


def _sums_of_values(flat: DataFrame, names: list[str]) -> DataFrame:
    """The same over distinct values, however many: sums within ranges of values, plus those of the ranges before; thresholds lie between neighbours."""
    flat = materialised(flat.repartitionByRange(*KEYS, "bin").withColumn("part", F.spark_partition_id()), "split-values")
    every = Window.partitionBy(*KEYS).orderBy("part")  # a row for each range
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    per = flat.groupBy(*KEYS, "part").agg(F.min("bin").alias("first"), *[F.sum(x).alias(f"p{x}") for x in names])
    offsets = [F.coalesce(F.sum(f"p{x}").over(before), F.lit(0)).alias(f"o{x}") for x in names]
    per = per.select(*KEYS, "part", F.lead("first").over(every).alias("beyond"), *offsets, *[F.sum(f"p{x}").over(Window.partitionBy(*KEYS)).alias(f"t{x}") for x in names])
    own = Window.partitionBy(*KEYS, "part").orderBy("bin")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    c = flat.join(per, [*KEYS, "part"]).withColumn("threshold", (F.col("bin") + F.coalesce(F.lead("bin").over(own), "beyond")) / 2)
    return c.select("*", *[(F.col(f"o{x}") + F.sum(x).over(upto)).alias(f"l{x}") for x in names])


def candidates(hist: DataFrame, width: int, classification: bool, min_leaf: int = 1, monotone: list[int] | None = None, exact: bool = False, beside: int = 0) -> DataFrame:
    """Every admissible split with its gain and the sums of both children; s holds as many more sums as beside says, which no gain depends on."""
    names = ["n", "w", *[f"s{k}" for k in range(width + beside)]]
    flat = hist.select(*KEYS, "bin", "n", "w", *[F.col("s")[k].alias(f"s{k}") for k in range(width + beside)])
    c = _sums_of_values(flat, names) if exact else _sums_of_bins(flat, names)
    for name in names:
        c = c.withColumn(f"r{name}", F.col(f"t{name}") - F.col(f"l{name}"))
    c = c.filter((F.col("ln") >= min_leaf) & (F.col("rn") >= min_leaf) & (F.col("lw") > 0) & (F.col("rw") > 0))
    if classification:
        imp = {side: gini([F.col(f"{side}s{k}") for k in range(width)], F.col(f"{side}w")) for side in "tlr"}
    else:
        imp = {side: variance(F.col(f"{side}w"), F.col(f"{side}s0"), F.col(f"{side}s1")) for side in "tlr"}
        lmean, rmean = F.col("ls0") / F.col("lw"), F.col("rs0") / F.col("rw")
        for f, sign in enumerate(monotone or []):
            if sign:
                c = c.filter((F.col("feature") != f) | ((lmean <= rmean) if sign > 0 else (lmean >= rmean)))
    gain = imp["t"] - (F.col("lw") * imp["l"] + F.col("rw") * imp["r"]) / F.col("tw")
    c = c.withColumn("parent", imp["t"]).withColumn("gain", gain)
    sums = [F.array(*[f"{side}s{k}" for k in range(width + beside)]).alias(f"{side}s") for side in "tlr"]
    return c.select(*KEYS, "bin", "threshold", "gain", "parent", "tn", "ln", "rn", "tw", "lw", "rw", *sums)


def best(cands: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The split of largest gain of each node; ties go to the lowest feature, then the lowest bin."""
    ok = cands.filter(F.col("gain") > tolerance * F.greatest(F.lit(1.0), F.col("parent")))
    top = F.max_by(F.struct(*[c for c in ok.columns if c not in ("tree_id", "node_id")]), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return ok.groupBy("tree_id", "node_id").agg(top.alias("b")).select("tree_id", "node_id", "b.*")
