import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import search
from tallyspark.llm.common import documents, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df, wanted, out = Counter(t for _, c, _ in counted for t in c), {}, []
    for i, t in items:
        wanted.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    for item, terms in wanted.items():
        found = []
        for i, tf, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                for t, q in terms.items()
                if t in tf
            )
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=order)


def order(r):
    return r[0] is not None, r[0] or 0, r[1]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=order)


@pytest.mark.parametrize("seed,block,shard", [(1, 1 << 24, 1 << 14), (2, 200, 10), (3, 1 << 24, 25)])
def test_random_texts(spark, seed, block, shard):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Zé9", "A"]

    def text(n):
        return r.choice([" ", "-", "\t"]).join(words[min(r.randrange(63), r.randrange(63))] for _ in range(r.randrange(n)))

    docs = [(r.choice([i, i, i, 7, None]), r.choice([text(40), text(5), text(200), None, "", "w1 w2"])) for i in range(200)]
    items = [(r.choice([i, i, 1, None]), text(30)) for i in range(10)] + [(99, None), (98, "not there")]
    got = search.search(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(4),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string"), 7, block, shard,
    )
    assert found(got) == plain(docs, items, 7)


def test_given_tables(spark):
    docs, items = (t(spark, "/root/testdata/sf0.001", *n) for t, n in ((documents, ()), (table, ("benchmark",))))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert found(search.search_table(docs, items)) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "b " * 3_000_000 + "a"), (2, "..."), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b"), (2, "--")], "item_id long, text string")
    assert found(search.search_table(docs, items)) == plain([(1, "b " * 3_000_000 + "a")], [(1, "a b")])
    assert search.search_table(docs.limit(0), items).collect() == []
    assert search.search_table(docs, items.limit(0)).collect() == []
    assert search.search_table(docs.filter("doc_id > 1"), items).collect() == []


def test_range_maxima():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 5 * 90, 300))
    index = search.Index(keys % 90, keys // 90, r.integers(1, 9, len(keys)), 90, 5)
    for t in range(5):
        lo, hi = index.first[t], index.first[t + 1]
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                at = index.largest(np.array([a]), np.array([b]))[0]
                assert a <= at < b and index.impact[at] == index.impact[a:b].max()
