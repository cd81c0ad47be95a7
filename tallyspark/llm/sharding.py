"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 in key order. A Feistel network over the smallest a x b grid that holds N numbers permutes
the grid; numbers that land outside 0..N-1 walk on along their cycle until they are inside, which is a permutation
of 0..N-1. Position p goes to shard p mod k and slot p div k, so shards differ by one row at most, slots have no
gaps, and both follow from the row number, N, the seed and k alone, in either direction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, mixed, staged

ROUNDS = 6


class Permutation:
    """A seeded permutation of 0..n-1 for numpy arrays; ``inverse`` undoes ``forward``."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.seed = n, seed
        self.a = math.isqrt(max(n, 1) - 1) + 1
        self.b = -(-max(n, 1) // self.a)

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if r % 2 == 0:
                f = (mixed(right, self.seed * ROUNDS + r) % np.uint64(self.a)).astype(np.int64)
                left = (left - f if back else left + f) % self.a
            else:
                f = (mixed(left, self.seed * ROUNDS + r) % np.uint64(self.b)).astype(np.int64)
                right = (right - f if back else right + f) % self.b
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._step(np.asarray(x, dtype=np.int64), back)
        while (outside := out >= self.n).any():
            out[outside] = self._step(out[outside], back)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def numbered(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with global row numbers 0..N-1 in the order of ``keys`` as column ``name``, and N.

    A range shuffle puts rows in order; each partition counts its own rows; only the counts, one row per partition,
    are summed up in one place. The ordered rows are written once, so that both steps see the same partitions.
    Rows with equal keys get neighbouring numbers in no defined order.
    """
    part, pos, base = fresh(df.columns, "part"), fresh(df.columns, "pos"), fresh(df.columns, "base")
    rows = staged(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({part: F.spark_partition_id(), pos: F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}),
        "numbered",
    )
    counts = rows.groupBy(part).agg(F.count("*").alias(base))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(
        counts.select(part, F.col(base).alias("n"), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base)), "starts"
    )
    n = starts.agg(F.sum("n")).first()[0] or 0
    # One row per shuffle partition: the bound of the broadcast is the number of partitions.
    out = rows.join(F.broadcast(starts.drop("n")), part).withColumn(name, F.col(base) + F.col(pos))
    return out.select(*df.columns, name), n


def permuted(row: Column, n: int, seed: int) -> Column:
    order = Permutation(n, seed)

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(order.forward(x.to_numpy()))

    return place(row)


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 0, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` with a shard (int, 0 to ``shards``-1) and a slot (long, without gaps from 0 in each shard).

    Shard sizes differ by one row at most, whatever the keys hold. The same rows, seed and number of shards give the
    same result; rows with equal keys may swap places. Null keys come first. An empty frame gives an empty frame.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    row, place = fresh(df.columns, "row"), fresh(df.columns, "place")
    rows, n = numbered(df, keys, row)
    return rows.withColumn(place, permuted(F.col(row), n, seed)).select(
        *df.columns,
        (F.col(place) % shards).cast("int").alias(names[0]),
        F.expr(f"`{place}` div {shards}").alias(names[1]),
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 6) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32, law ``rows``, shard, slot, grown_shard (null)."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    placed = shard(rows, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
