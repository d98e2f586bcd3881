"""Training frames: named columns to the ordered arrays that learners use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where that is unset, our own on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="spark-")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that loops don't grow the lineage."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialised`` wrote and nothing reads any more; others are left alone."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds the 0-based position in a total order, by range partitions and their offsets: no single-task window."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(cols)])
    keys = [f"_k{i}" for i in range(len(cols))]
    parts = keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = materialised(parts, "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row per partition
    own = Window.partitionBy("_part").orderBy(*keys)
    out = parts.withColumn("_at", F.row_number().over(own) - 1).join(sizes, "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_before", "_at", *keys)


def training_frame(df: DataFrame, row_id: str, features: list[str], target: str, weight: str | None = None) -> DataFrame:
    """(row_id, x array<double>, y double, w double) from named columns."""
    return df.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.col(target).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, f0..f3, y): total price, priority, month and year against status F."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("f0"), F.substring("o_orderpriority", 1, 1).cast("double").alias("f1"),
        F.month("o_orderdate").cast("double").alias("f2"), F.year("o_orderdate").cast("double").alias("f3"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y"), F.col("o_orderstatus").alias("status"),
    )


def customer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, f0 nation, f1 balance, f2 segment code, y): whether the balance is over 4500 is never a feature's own column."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("rid"), F.col("c_nationkey").cast("double").alias("f0"), F.col("c_acctbal").alias("f1"),
        F.length("c_mktsegment").cast("double").alias("f2"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 3 == 0).cast("double").alias("y"),
    )
