"""Rank-based bin edges and bin assignment.

Edges are the values at ranks (b * n) div bins, b = 1..bins-1, of each
feature, distinct, then +inf; bins is the number of distinct values, 256 at
most; a feature with one value has the single edge +inf. A value's bin is the
number of edges below it. (With this rule the smallest value of a balanced
two-valued feature gets no edge of its own, so it can't be split; that is kept.)

Ranks come from running totals of value counts, in range partitions with
offsets, so no feature is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.sources.frames import materialised

BINS = 256


def value_counts(frame: DataFrame) -> DataFrame:
    """(feature, v, n, rows, uniques, before): before is how many rows have a smaller value."""
    c = frame.select(F.posexplode("x").alias("feature", "v")).groupBy("feature", "v").agg(F.count("*").alias("n"))
    c = materialised(c.repartitionByRange("feature", "v").withColumn("part", F.spark_partition_id()), "value-counts")
    per = c.groupBy("feature", "part").agg(F.sum("n").alias("pn"), F.count("*").alias("pu"))
    every = Window.partitionBy("feature")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("feature", "part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("off"), F.sum("pn").over(every).alias("rows"), F.sum("pu").over(every).alias("uniques"))
    own = Window.partitionBy("feature", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("local", F.coalesce(F.sum("n").over(own), F.lit(0))).join(per, ["feature", "part"]).select("feature", "v", "n", "rows", "uniques", (F.col("off") + F.col("local")).alias("before"))


def bin_edges(frame: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, edge)."""
    c = value_counts(frame).withColumn("bins", F.least("uniques", F.lit(bins)))
    first = F.greatest(F.lit(1), F.expr("(before * bins + rows - 1) div rows"))
    last = F.least(F.col("bins") - 1, F.expr("((before + n) * bins + rows - 1) div rows - 1"))
    picked = c.filter((F.col("uniques") > 1) & (first <= last)).select("feature", F.col("v").alias("edge"))
    top = c.select("feature").distinct().select("feature", F.lit(float("inf")).alias("edge"))
    w = Window.partitionBy("feature").orderBy("edge")  # at most ``bins`` rows a feature
    return picked.unionByName(top).withColumn("bin", (F.row_number().over(w) - 1).cast("int")).select("feature", "bin", "edge")


def edge_lists(edges: DataFrame) -> list[list[float]]:
    """Edges by feature on the driver: at most 256 numbers a feature."""
    out: dict[int, list[float]] = {}
    for r in edges.orderBy("feature", "bin").collect():
        out.setdefault(r["feature"], []).append(r["edge"])
    return [out[f] for f in sorted(out)]


def matrix(column, kind: type = float) -> np.ndarray:
    """Arrays of equal length, a row each."""
    return np.concatenate(column.to_numpy()).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def assign_bins(frame: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Adds b array<int>: each feature's bin, by binary search in Arrow batches."""
    cuts = [np.array(e) for e in edges]
    names = frame.columns

    def run(batches):
        for pdf in batches:
            x = matrix(pdf["x"])
            b = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(cuts)], axis=1).astype(np.int32) if len(pdf) else np.zeros((0, len(cuts)), np.int32)
            yield pdf.assign(b=list(b))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + ", b array<int>"
    return frame.mapInPandas(run, schema).select(*names, "b")


def bin_of(value, edges: list[float]):
    """A bin as a column expression, for small edge lists."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value))


__all__ = ["BINS", "assign_bins", "bin_edges", "bin_of", "edge_lists", "matrix", "value_counts"]
