"""Checks before a fit: finite cells, weights, class labels, constraints, feature counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bad(c):
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite_report(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """One row: the number of bad cells and the first one in row-major order (nulls if none), in one pass."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), _bad(F.col(c).cast("double")).alias("bad")) for i, c in enumerate(columns)])
    bad = df.select(F.col(row_id).cast("long").alias("row"), F.transform(F.filter(cells, lambda s: s["bad"]), lambda s: s["col"]).alias("cols")).filter("size(cols) > 0")
    return bad.agg(F.coalesce(F.sum(F.size("cols")), F.lit(0)).cast("long").alias("n_bad"), F.min(F.struct("row", F.array_min("cols").alias("col"))).alias("first")).select("n_bad", F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"))


def check_finite(df: DataFrame, row_id: str, columns: list[str], target: str | None = None) -> None:
    r = finite_report(df, row_id, columns).first()
    if r["n_bad"]:
        raise ValueError(f"X has a value that isn't finite at row {r['first_row']}, column {columns[r['first_col']]}")
    if target is not None:
        r = finite_report(df, row_id, [target]).first()
        if r["n_bad"]:
            raise ValueError(f"y has a value that isn't finite at row {r['first_row']}")


def weights_report(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight).cast("double")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_bad(w).cast("long")), F.lit(0)).cast("long").alias("n_not_finite"), F.coalesce(F.sum((w < 0).cast("long")), F.lit(0)).cast("long").alias("n_negative"))


def check_weights(df: DataFrame, weight: str) -> None:
    r = weights_report(df, weight).first()
    if r["n_not_finite"] or r["n_negative"]:
        raise ValueError("sample weights must be finite and not negative")


def classes(df: DataFrame, target: str) -> DataFrame:
    """Distinct labels as integers, in order."""
    return df.select(F.col(target).cast("int").alias("label")).distinct().orderBy("label")


def check_labels(df: DataFrame, target: str) -> int:
    """The number of classes; labels must be 0..K-1."""
    r = df.agg(F.countDistinct(F.col(target).cast("int")).alias("k"), F.min(F.col(target).cast("int")).alias("lo"), F.max(F.col(target).cast("int")).alias("hi")).first()
    if r["k"] == 0 or r["lo"] != 0 or r["hi"] != r["k"] - 1:
        raise ValueError("class labels must be 0..K-1; index them first")
    return int(r["k"])


def check_fit(df: DataFrame, row_id: str, columns: list[str], target: str, weight: str | None = None, labels: bool = False) -> int | None:
    """All checks before a fit in one pass over df: finite columns and target, weights, and (labels) classes, whose number is returned.

    With labels, rows are summed by label before they are shuffled. Errors come in the order of the checks on their own.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("col"), _bad(F.col(c).cast("double")).alias("bad")) for i, c in enumerate(columns)])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(
        F.col(row_id).cast("long").alias("row"),
        F.transform(F.filter(cells, lambda s: s["bad"]), lambda s: s["col"]).alias("cols"),
        _bad(F.col(target).cast("double")).alias("bad_y"),
        (_bad(w) | (w < 0)).alias("bad_w"),
        (F.col(target).try_cast("int") if labels else F.lit(None).cast("int")).alias("label"),
    )
    by = rows.groupBy("label").agg(
        F.min(F.when(F.size("cols") > 0, F.struct("row", F.array_min("cols").alias("col")))).alias("x"),
        F.count_if("bad_y").alias("n_y"), F.min(F.when(F.col("bad_y"), F.col("row"))).alias("y"), F.count_if("bad_w").alias("n_w"),
    )
    r = by.agg(F.min("x").alias("x"), F.sum("n_y").alias("n_y"), F.min("y").alias("y"), F.sum("n_w").alias("n_w"), F.count("label").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if r["x"] is not None:
        raise ValueError(f"X has a value that isn't finite at row {r['x']['row']}, column {columns[r['x']['col']]}")
    if r["n_y"]:
        raise ValueError(f"y has a value that isn't finite at row {r['y']}")
    if r["n_w"]:
        raise ValueError("sample weights must be finite and not negative")
    if not labels:
        return None
    if r["k"] == 0 or r["lo"] != 0 or r["hi"] != r["k"] - 1:
        raise ValueError("class labels must be 0..K-1; index them first")
    return int(r["k"])


def max_features(spec, p: int) -> int:
    """Number of features tried at a node: sqrt, log2, a share up to 1 or a count; anything else means all."""
    if spec is None:
        return p
    text = str(spec)
    if text == "sqrt":
        return max(1, int(math.sqrt(p)))
    if text == "log2":
        return max(1, int(math.log2(p)))
    try:
        v = float(text)
    except ValueError:
        return p
    return max(1, int(v * p)) if v <= 1 else int(v)


def monotone(constraints: dict | None, features: list[str]) -> list[int]:
    """One sign per feature from {name or index: direction}."""
    out = [0] * len(features)
    for k, v in (constraints or {}).items():
        at = features.index(k) if k in features else k
        if not isinstance(at, int) or not 0 <= at < len(features):
            raise ValueError(f"monotone constraint on unknown feature {k!r}")
        out[at] = (v > 0) - (v < 0)
    return out
