"""What op6's steps shuffle is let go when they have ended."""

import re
import time

from pyspark.sql import functions as F

from copse.llm import substring_dedup
from copse.llm.common import table


def shuffle_ids(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"/shuffle_(\d+)_\d+_\d+\.data", files))


def test_steps_leave_no_shuffle_files(spark, sf_dir):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_ids(spark), spark.conf.get(key)
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    left = shuffle_ids(spark) - before
    for _ in range(20):
        if not left:
            break
        time.sleep(0.5)
        left = shuffle_ids(spark) - before
    assert not left
    assert spark.conf.get(key) == was
    assert found.agg(F.sum("n_removed")).first()[0] > 0
