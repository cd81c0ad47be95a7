import zlib

import numpy as np
import pytest

from tallyspark.llm.sharding import Permutation, shard, shard_documents


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation_and_inverse(n):
    p = Permutation(n, 5)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert p.inverse(out).tolist() == list(range(n))
    assert n < 100 or (Permutation(n, 6).forward(np.arange(n)) != out).any()


def test_large_numbers_stay_inside():
    n = 10**13 + 7
    x = np.arange(0, n, n // 1000)
    p = Permutation(n, 1)
    y = p.forward(x)
    assert (y < n).all() and (p.inverse(y) == x).all()


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7)) for i in range(1003)] + [(None, "x"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = shard_documents(df).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and len(counts) == 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == want
    again = shard_documents(df.repartition(3)).collect()
    key = lambda rs: sorted(tuple(-1 if v is None else v for v in r) for r in rs if r.doc_id != 5)
    assert key(out) == key(again)
    # Shard and slot follow from the row number.
    p = Permutation(len(rows), 6)
    by_row = {int(p.inverse(np.array([r.slot * 24 + r.shard]))[0]): r.doc_id for r in out}
    assert [by_row[i] for i in range(len(rows))] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v))


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(empty).count() == 0
    df = spark.createDataFrame([(1, 2, 3, 4)], "row long, part long, pos long, place long")
    assert [tuple(r) for r in shard(df, ["row"], 3).collect()] == [(1, 2, 3, 4, 0, 0)]
    with pytest.raises(ValueError):
        shard(df, ["row"], 0)
