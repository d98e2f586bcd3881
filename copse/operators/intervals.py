"""Conformal split and calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.functions.scalar import draw
from copse.sources.frames import with_rank


def conformal_split(frame: DataFrame, share: float = 0.2, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Adds is_calibration: the last floor(n * share) rows of an order by hash."""
    n = frame.count()
    n_cal = int(n * share)
    d = with_rank(frame.withColumn("_h", draw(seed, F.lit("split"), F.col(row_id))), ["_h", row_id], "_r")
    return d.withColumn("is_calibration", F.col("_r") >= n - n_cal).drop("_h", "_r")


def conformal_rank(n: int, level: float = 0.95) -> int:
    """0-based rank of the residual taken: min(ceil(level (1 + 1/n) n), n - 1), one rank to the safe side."""
    return min(math.ceil(level * (1 + 1 / n) * n), n - 1)


def conformal_quantile(residuals: DataFrame, column: str = "residual") -> DataFrame:
    """One row q: the absolute residual at the conformal rank, by distributed ranks."""
    n = residuals.count()
    if n == 0:
        raise ValueError("no calibration rows")
    return with_rank(residuals.select(F.abs(F.col(column)).alias("r")), ["r"], "k").filter(F.col("k") == conformal_rank(n)).agg(F.max("r").alias("q"))
