"""Shared helpers: tables, folders that all executors see, small column forms."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where that is unset, one of our own on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # for copse.sources.frames.dropped
    return out


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession):
    """Within it, a write's shuffle files go when it has ended, not whenever the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df has it (names don't differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """At a task's end: memory of freed objects goes back to the system, as Python workers outlive their tasks."""
    gc.collect()
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


_HELD: dict = {}


def held(key: str, make):
    """make(), kept in this worker process for the other tasks of the stage; one value at a time."""
    task = TaskContext.get()
    at = key, task.stageId() if task else -1
    if at not in _HELD:
        let_go()
        _HELD[at] = make()
    return _HELD[at]


def let_go() -> None:
    """Frees what an earlier stage held in this worker process."""
    if _HELD:
        _HELD.clear()
        give_back()
