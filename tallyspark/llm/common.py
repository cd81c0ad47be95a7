"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import scratch_path

#: White space between words: blank and the controls 9 to 13. ``bytes.split()`` cuts at the same characters.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: later steps neither repeat it nor need its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def smallest(rows: DataFrame, group: str, key: str, k: Column) -> DataFrame:
    """``rows`` (group, key, ...) with ``rank``: of each group, the ``k`` rows with the smallest hash of the key.

    Hashes are even, so twice the share that k rows need is ranked, and a hot group brings about 2 k rows together. The
    rows of ``k`` per group (groups are few: languages, classes) bound the broadcast.
    """
    h, size = F.xxhash64(key), fresh(rows.columns, "size")
    counts = rows.groupBy(group).agg(F.count("*").alias(size))
    near = rows.join(F.broadcast(counts), group).filter(h.cast("double") / 2.0**64 + 0.5 <= 2 * k / F.col(size) + 1e-9)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return near.drop(size).withColumn("rank", rank).filter(F.col("rank") <= k)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``work`` maps an Arrow batch to dicts of columns, each of which becomes a batch of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((columns[f.name] for f in arrow), arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as UTF-8, null as empty, without decoding them."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix (splitmix64) of unsigned integers under a key."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
