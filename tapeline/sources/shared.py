"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that are few enough to be sent to every task.
SMALL = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, which only a local master can have."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once, with their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """Hints a broadcast where the table has few rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
