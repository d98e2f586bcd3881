"""Lloyd clustering of embeddings in integers, so that every run gives the same clusters to the last digit.

A component x becomes floor(64 * x), exact as 64 is a power of two. A round
sends the centroids (k x dimensions integers, whatever the number of rows) to
the tasks; each takes integer squared differences per centroid, a row goes to
the nearest (the lowest number among equals), and a task returns one row of
integer sums for each cluster it met. These are added by a groupBy, and the
driver gets k rows. Integer sums don't depend on partitions or their order.
The integer vectors are written once to the shared folder and reread by each
round; no round adds to the lineage.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; a null id is kept, sorts last as a start and
stays null; repeated rows are separate vectors, and repeated ids tie as starts
by their components; with fewer vectors than centroids each vector is a start;
empty clusters keep their centroid; an empty table gives no rows; a component
whose integer is beyond +-2**20 (a value beyond +-16,384) counts as that bound,
so a distance fits a long; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import stored

SCALE, BOUND = 64, 1 << 20


def whole(x: Column) -> Column:
    """floor(64 * x) of an array as integers, within the bound."""
    cut = lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND))
    return F.transform(x, lambda v: cut(v).cast("int"))


def vectors(df: DataFrame, dimensions: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q array<int>) of the vectors that are kept."""
    x = F.col(embedding)
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kept = df.filter((F.size(x) == dimensions) & F.forall(x, real))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole(x).alias("q"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:vec_id", in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; the lowest number among equals."""
    d = np.empty((len(centroids), len(q)), np.int64)
    for i, c in enumerate(centroids):
        off = q - c
        d[i] = np.einsum("ij,ij->i", off, off)
    at = d.argmin(axis=0)
    return at, d[at, np.arange(len(q))]


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): integer sums of the vectors nearest to each centroid; a task returns a row for each cluster."""
    k, p = centroids.shape
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, p), np.int64)
        for pdf in batches:
            if len(pdf):
                q = matrix(pdf["q"])
                at, _ = nearest(q, sent.value)
                n += np.bincount(at, minlength=k)
                for c in np.unique(at):
                    sums[c] += q[at == c].sum(axis=0)
        met = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": n[met], "sums": list(sums[met])})

    part = rows.select("q").mapInPandas(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"_{i}") for i in range(p)]
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *total).select("cluster", "n", F.array(*[f"_{i}" for i in range(p)]).alias("sums"))


def updated(centroids: np.ndarray, sums: list) -> np.ndarray:
    """The floor of each component's mean; empty clusters stay."""
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def fit(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids after the rounds; rows is a stored table (vec_id, q), read once by each round."""
    centroids = starts(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = updated(centroids, cluster_sums(rows, centroids).collect())  # k rows
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) by the centroids given."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                at, d = nearest(matrix(pdf["q"]), sent.value)
                yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "cluster": at.astype(np.int32), "distance": d})

    return rows.mapInPandas(run, "vec_id long, cluster int, distance long")


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids)."""
    rows = stored(vectors(df, dimensions), "vectors")
    centroids = fit(rows, k, rounds, seed)
    return assign(rows, centroids.reshape(-1, dimensions)), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. A sum beyond a long is null."""
    spark = found.sparkSession
    found = stored(found, "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda v: v if v < 1 << 63 else None
    of = [(c, fits(s), fits(sum(sums.values())), digest(centroids[c])) for c, s in sorted(sums.items())]
    about = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
