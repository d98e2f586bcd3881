"""Scoring: CASE expressions for one small tree; for ensembles, Arrow batches with the model in broadcasts of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.operators.binning import matrix
from copse.operators.trees import Trees, descend


def case_expression(trees: Trees, features: list[Column], tree_id: int = 0, what: str = "value") -> Column:
    """One tree as nested CASE WHEN (whole-stage code): its value, class shares or leaf id."""

    def build(i: int) -> Column:
        n = trees.nodes[tree_id, i]
        if n.is_leaf:
            return F.lit(trees.value(n)) if what == "value" else F.lit(i).cast("long") if what == "leaf" else F.array(*[F.lit(s) for s in trees.shares(n)])
        return F.when(features[n.feature] <= F.lit(float(n.threshold)), build(n.left_id)).otherwise(build(n.right_id))

    return build(0)


#: Rows that a task takes through the blocks of a large model at a time.
CHUNK = 100_000


def sent(spark, trees: Trees) -> list:
    """The model as broadcasts of at most a block each; the driver lets a block go before it reads the next."""
    return [spark.sparkContext.broadcast(make()) for make in trees.blocks()]


def blocks_of(model: list):
    """The blocks' arrays, one at a time; a task holds the only block of a small model, and of a large one the block at hand."""
    for b in model:
        yield b.value
        if len(model) > 1:
            vars(b).pop("_value", None)  # read again from the executor's disk when asked


def chunks(batches, several: bool):
    """Frames of rows: the batches, or, before several blocks, larger ones made of them."""
    held, size = [], 0
    for pdf in batches:
        if not several:
            yield pdf
            continue
        held.append(pdf)
        size += len(pdf)
        if size >= CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _batches(frame: DataFrame, fn, extra: str, several: bool) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + ", " + extra

    def run(batches):
        for pdf in chunks(batches, several):
            yield fn(pdf)

    return frame.mapInPandas(run, schema)


def ensemble(frame: DataFrame, trees: Trees, column: str = "raw", x: str = "x") -> DataFrame:
    """Adds the mean over trees: a value (regression) or class shares (classification, soft vote); x names the array of features."""
    model, n_trees = sent(frame.sparkSession, trees), max(1, len(trees.tree_ids))
    cls, width = trees.config.classification, trees.config.width

    def fn(pdf):
        values = matrix(pdf[x])
        total = np.zeros((len(pdf), width) if cls else len(pdf))
        for parts in blocks_of(model) if len(pdf) else ():
            for t in parts:
                total += t["shares" if cls else "value"][descend(t, values)]
        return pdf.assign(**{column: list(total / n_trees)})

    return _batches(frame, fn, f"{column} {'array<double>' if cls else 'double'}", len(model) > 1)


def per_tree(frame: DataFrame, trees: Trees) -> DataFrame:
    """(row_id, tree_id, value, leaf): one row per row and tree."""
    model = sent(frame.sparkSession, trees)

    def run(batches):
        for pdf in chunks(batches, len(model) > 1):
            x, rows = matrix(pdf["x"]), pdf["row_id"].to_numpy()
            for parts in blocks_of(model):
                for t in parts:
                    at = descend(t, x)
                    own = t["real"][at]
                    at = at[own]
                    yield pd.DataFrame({"row_id": rows[own], "tree_id": int(t["tree_id"]), "value": t["value"][at], "leaf": t["node_id"][at]})

    return frame.select("row_id", "x").mapInPandas(run, "row_id long, tree_id int, value double, leaf long")


def argmax_class(shares: Column) -> Column:
    """Index of the largest share; ties go to the highest class."""
    return (F.size(shares) - F.array_position(F.reverse(shares), F.array_max(shares))).cast("int")
