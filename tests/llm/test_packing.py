import random

import numpy as np
import pandas as pd
import pytest

from tallyspark.llm.packing import best_fit, bits_of, pack, pack_documents


def plain(lengths, conflicts, capacity):
    bins = []  # residual, sets
    out = []
    for i, n in enumerate(lengths):
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and not any(c[i] >= 0 and c[i] in s for c, s in zip(conflicts, b[1]))]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([capacity, [set() for _ in conflicts]])
        bins[k][0] -= n
        for c, s in zip(conflicts, bins[k][1]):
            s.add(c[i])
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest_compatible_bin(seed):
    r = random.Random(seed)
    lengths = sorted((r.randint(1, 100) for _ in range(400)), reverse=True)
    conflicts = [np.array([r.choice([-1, 0, 0, 0, 1, 70]) for _ in lengths]), np.array([r.choice([-1, -1, -1, 3, 130]) for _ in lengths])]
    bins, offsets, residual = best_fit(np.array(lengths), conflicts, 100)
    assert bins.tolist() == plain(lengths, conflicts, 100)
    for b in set(bins.tolist()):
        at = 0
        for i in np.flatnonzero(bins == b):
            assert offsets[i] == at
            at += lengths[i]
        assert residual[b] == 100 - at


def test_bits_only_for_values_that_repeat():
    assert bits_of(pd.Series([5.0, None, 7, 5, 7, 9])).tolist() == [0, -1, 1, 0, 1, -1]
    assert bits_of(pd.Series([], dtype=float)).tolist() == []


def test_pack(spark):
    rows = [(i, (i * 37) % 230, f"s{i % 5}" if i % 3 else "hot", i // 4 if i % 2 else None) for i in range(300)]
    rows += [(None, 10, None, None), (1, None, "s1", 1), (1, 25, "s1", 1), (1, 25, "s1", 1), (9000, 5000, "long", 3)]
    df = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")
    out = pack(df, capacity=100, group_rows=128).collect()
    assert sum(r.n_words for r in out) == sum(x[1] or 0 for x in rows)
    assert sum(r.bin is None for r in out) == sum(not x[1] for x in rows)
    meta = {x[0]: x for x in rows if x[0] not in (None, 1)}
    bins = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= 100 and all(r.residual == 100 - at for r in pieces)
        known = [meta[r.doc_id] for r in pieces if r.doc_id in meta]
        assert len({x[2] for x in known}) == len(known)
        clusters = [x[3] for x in known if x[3] is not None]
        assert len(set(clusters)) == len(clusters)
    long = sorted((r.piece, r.start, r.n_words) for r in out if r.doc_id == 9000)
    assert long == [(k, 100 * k, 100) for k in range(50)]
    assert sorted(map(str, pack(df.repartition(5), capacity=100, group_rows=128).collect())) == sorted(map(str, out))


def test_pack_documents_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack_documents(empty).count() == 0
    df = spark.createDataFrame(
        [(1, "a b\tc", "s", 7), (2, "A  b c", "t", 7), (3, None, "u", 7), (4, " \n", None, 7), (5, "x y", None, 7)],
        "doc_id long, text string, source string, bin int",
    )
    out = {r.doc_id: r for r in pack_documents(df, capacity=10).collect()}
    assert [out[i].n_words for i in (1, 2, 3, 4, 5)] == [3, 3, 0, 0, 1]
    assert out[1].bin != out[2].bin and out[3].bin is None and out[4].bin is None


def test_white_space_does_not_tell_copies_apart(spark):
    texts = ["a b c", " A b c", "a b c\n", "a\t b  c ", "a b d"]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    bins = {r.doc_id: r.bin for r in pack_documents(docs).collect()}
    assert len({bins[i] for i in range(4)}) == 4 and bins[4] in {bins[i] for i in range(4)}
