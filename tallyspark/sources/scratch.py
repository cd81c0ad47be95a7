"""Shared scratch space and small measured lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_base() -> str:
    """One temporary folder per process, removed at its end."""
    base = tempfile.mkdtemp(prefix="tallyspark-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``; a temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows that a task of a dealt frame gets, about.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """The tasks to which rows made from those of ``df`` are dealt: as many as a shuffle has, and more above TASK_ROWS
    rows each, so that what a task holds does not grow with the table. Columnar files are counted by their footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def measured(df: DataFrame) -> DataFrame:
    """Cache a frame that is reduced to few rows and run it once, so that the planner knows its true size.

    A join against it is then broadcast if, and only if, that size is below the broadcast threshold; a larger
    one is shuffled as usual. Lost blocks are computed again from the lineage.
    """
    df = df.persist()
    df.count()
    return df
