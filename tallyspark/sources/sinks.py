"""Writers. All write in parallel from the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import measured


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def export_summary(df: DataFrame, path: str) -> None:
    """A summary for people: CSV with a heading, replaced on every run."""
    write_result(df, path, "csv", "overwrite")


def split_hot(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that fit into a bucket, and rows of keys that hold more than one in ``buckets`` of all rows.

    There are fewer than ``buckets`` such keys (null may be one), which bounds their broadcast.
    """
    least = df.count() / buckets
    counts = df.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(measured(counts.filter(F.col("__n") > least).drop("__n")))
    same = F.col(key).eqNullSafe(F.col("__hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table in buckets of a key, one file per bucket, sorted by the key; returned as read from there.

    Tables with the same number of buckets join and group by the key without a shuffle. A bucket is read by one task:
    split off hot keys first (``split_hot``).
    """
    writer = df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
