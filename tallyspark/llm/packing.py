"""Best-fit packing of documents into sequences under conflicts.

A sequence (bin) holds ``capacity`` words. Two documents of one source, or of one cluster of duplicates, never share
a bin. A document longer than a bin fills whole bins of its own; what is left over is packed.

Leftovers are dealt evenly to groups by the Feistel permutation of their row numbers, so a group has ``group_rows``
rows at most, whichever source or cluster is hot, and groups are packed side by side. Inside a group, longest first,
a leftover goes to the bin with the smallest residual that can take it: bins stand in the order of their residuals,
each with a bitmap of its sources and one of its clusters, and the search goes on from successor to successor until a
bin has neither bit set. If there is none, a new bin is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, fresh
from .sharding import shard

SCHEMA = "doc_id long, piece int, start long, n_words long, bin long, bin_offset int, residual int"


def bits_of(values: pd.Series) -> np.ndarray:
    """A bit number for each value that occurs twice or more, else -1: single values conflict with nothing."""
    codes, uniques = pd.factorize(values, use_na_sentinel=True)
    counts = np.bincount(codes[codes >= 0], minlength=len(uniques))
    number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return np.where(codes >= 0, number[codes] if len(uniques) else -1, -1)


def best_fit(lengths: np.ndarray, conflicts: list[np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order, and the bins' residuals.

    ``conflicts`` has bit numbers per item (-1: none); items with an equal number in one of them never share a bin.
    """
    n = len(lengths)
    maps = [np.zeros((n, max(1, (int(c.max(initial=-1)) >> 6) + 1)), np.uint64) for c in conflicts]
    order = np.empty(n + 1, np.int64)  # residual and bin of the open bins in one number, ascending
    used, residual = 0, np.full(n, capacity, np.int64)
    bins, offsets, opened = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for i in range(n):
        length, marks = int(lengths[i]), [(m, int(c[i]) >> 6, np.uint64(1 << (int(c[i]) & 63))) for m, c in zip(maps, conflicts) if c[i] >= 0]
        at, step, found = int(np.searchsorted(order[:used], length << 32)), 16, -1
        while at < used:
            ahead = order[at : min(used, at + step)] & 0xFFFFFFFF
            free = np.ones(len(ahead), bool)
            for m, word, bit in marks:
                free &= (m[ahead, word] & bit) == 0
            if (k := int(free.argmax())) or free[0]:
                found, at = int(ahead[k]), at + k
                break
            at, step = at + len(ahead), step * 4
        if found < 0:
            found, opened = opened, opened + 1
        else:
            order[at : used - 1] = order[at + 1 : used]
            used -= 1
        bins[i], offsets[i] = found, capacity - residual[found]
        residual[found] -= length
        for m, word, bit in marks:
            m[found, word] |= bit
        if residual[found] > 0:
            key = (int(residual[found]) << 32) | found
            at = int(np.searchsorted(order[:used], key))
            order[at + 1 : used + 1] = order[at:used]
            order[at] = key
            used += 1
    return bins, offsets, residual[:opened]


def pack(
    docs: DataFrame,
    length: str = "length",
    source: str = "source",
    cluster: str = "cluster",
    capacity: int = 2048,
    group_rows: int = 16384,
    seed: int = 1,
) -> DataFrame:
    """One row per piece of a document: where it starts, how many words it has, its bin, the offset there, and how much
    room the bin has left.

    ``docs`` has ``doc_id``, the length, source and cluster (null: no conflict). A document without words (or with a
    null length) gives one row with null bin. Repeated ids are separate documents; equal lengths are taken in the
    order of doc_id. Bins are numbered within groups (group in the upper half), so numbers are not consecutive.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"),
        F.when(F.col(source).isNotNull(), F.xxhash64(source)).alias("source"),
        F.col(cluster).cast("long").alias("cluster"),
    )
    n = rows.count()
    groups = max(1, -(-n // group_rows))
    dealt = shard(rows, ["doc_id", "length", "cluster", "source"], groups, seed, ("part", "slot"))
    size = capacity

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "slot"], na_position="first", kind="stable").reset_index(drop=True)
        part = int(frame["part"].iloc[0])
        total = frame["length"].to_numpy()
        full, rest = total // size, total % size
        left = np.flatnonzero(rest)
        left = left[np.argsort(-rest[left], kind="stable")]
        bins, offsets, residual = best_fit(rest[left], [bits_of(frame[c].iloc[left]) for c in ("source", "cluster")], size)
        whole = np.repeat(np.arange(len(frame)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        empty = np.flatnonzero(total == 0)
        none, zero = np.zeros(len(empty), np.int64), np.zeros(len(whole), np.int64)
        row = np.concatenate([left, whole, empty])
        piece = np.concatenate([full[left], nth, none])
        void = np.arange(len(row)) >= len(left) + len(whole)
        out = {
            "bin": part * 2**32 + np.concatenate([bins, len(residual) + np.arange(len(whole)), none]),
            "bin_offset": np.concatenate([offsets, zero, none]),
            "residual": np.concatenate([residual[bins], zero, none]),
        }
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].astype("Int64").array[row],
                "piece": piece,
                "start": piece * size,
                "n_words": np.concatenate([rest[left], zero + size, none]),
                **{c: pd.arrays.IntegerArray(v.astype(np.int64), void.copy()) for c, v in out.items()},
            }
        )

    return dealt.groupBy("part").applyInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = 2048, group_rows: int = 16384) -> DataFrame:
    """``pack`` with word counts as lengths; documents with the same words are one cluster, whatever their case and
    the white space between, before and behind them. Near copies are not. A null text has no words and no cluster."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("length"),
        "source",
        F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), GAP, " "))).alias("cluster"),
    )
    return pack(rows, capacity=capacity, group_rows=group_rows)
