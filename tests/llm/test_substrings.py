import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tallyspark.llm import substrings
from tallyspark.llm.substrings import COVER, PERIOD, Words, remove_repeats


def plain(rows, width=20):
    """Rows of (id, text) in order; equal rows count as one."""
    seen, out = {}, []
    cut = [(t or "").encode().split() for _, t in rows]
    for d, words in enumerate(cut):
        d = rows.index(rows[d])
        for s in range(len(words) - width + 1):
            seen.setdefault(tuple(words[s : s + width]), (d, s))
    for d, words in enumerate(cut):
        gone = set()
        for s in range(len(words) - width + 1):
            if seen[tuple(words[s : s + width])] != (rows.index(rows[d]), s):
                gone.update(range(s, s + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((rows[d][0], kept, len(words), len(gone)))
    return out


def test_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a, b in product(COVER, COVER)} == set(range(PERIOD))


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_word_hashes(monkeypatch, size):
    monkeypatch.setattr(substrings, "SLICE", size)
    column = [b"", b"one two\tone", b" ", "é two ".encode() + b"x" * 500 + b" one" * 40]
    w = Words(column)
    words = [x for t in column for x in t.split()]
    assert w.count.tolist() == [0, 3, 0, 43] and w.place.tolist() == [0, 1, 2, *range(43)]
    for k in (0, 1):
        assert len(set(w.hash[k].tolist())) == len(set(words))
        assert {(h, x) for h, x in zip(w.hash[k].tolist(), words)} == {(w.hash[k][words.index(x)], x) for x in words}


@pytest.mark.parametrize("seed,size", [(1, 1 << 20), (2, 300), (3, 5000)])
def test_random_texts(spark, monkeypatch, seed, size):
    r = random.Random(seed)
    passages = [[f"p{r.randrange(40)}" for _ in range(r.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randrange(6)):
            words += r.choice(passages)[r.randrange(4) :] if r.random() < 0.6 else [f"w{r.randrange(3)}" for _ in range(r.randrange(60))]
        rows.append((i - 20, r.choice([" ", "\n", " \t "]).join(words)))
    monkeypatch.setattr(substrings, "SLICE", size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, remove_repeats(df).collect())) == sorted(plain(rows))


def test_edges(spark):
    nineteen, twenty = " ".join(map(str, range(19))), " ".join(map(str, range(20)))
    long = " ".join(f"w{i * i % 100_003}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, nineteen), (5, nineteen), (6, twenty), (7, f"x  {twenty}\ty"), (7, "other"), (8, "one"), (9, long), (10, "a " + long)]
    rows += [(11, "same " * 50), (12, twenty), (12, twenty)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, tie int, DOC string")
    assert Counter(map(tuple, remove_repeats(df).collect())) == Counter(plain(rows))
    assert remove_repeats(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, twenty), (0, twenty), (None, twenty)], "doc_id long, text string")
    assert Counter(map(tuple, remove_repeats(null).collect())) == Counter({(None, twenty, 20, 0): 2, (0, "", 20, 20): 1})


def test_digest(spark):
    df = spark.createDataFrame([(1, " a  b\n")], "doc_id long, text string")
    assert [tuple(r) for r in substrings.repeats_table(df).collect()] == [(1, 2, 0, hashlib.sha256(b"a b").hexdigest())]
