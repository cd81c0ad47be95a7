"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions, also where that costs one more shuffle behind the join, and
# turns joins into broadcasts only when the measured side is below the threshold.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
SETTINGS = RUNTIME | {
    # Call sites in error messages cost a stack walk per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that a running session takes, on any cluster."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def local_session(name: str, cpus: int | str | None = None) -> SparkSession:
    cpus = cpus or os.cpu_count() or "*"
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
