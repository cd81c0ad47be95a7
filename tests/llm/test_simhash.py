import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyspark.llm import golay, simhash
from tallyspark.llm.common import documents
from tallyspark.llm.components import components


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    assert (np.bincount(golay.index(words)) == 1 << 11).all()


def test_golay_keys_are_shared_within_two_bits():
    r = random.Random(1)
    a, b = [], []
    for _ in range(3000):
        x = r.getrandbits(23)
        a.append(x)
        b.append(x ^ (1 << r.randrange(23)) ^ (1 << r.randrange(23)))
    for x, y in zip(golay.keys(np.array(a)), golay.keys(np.array(b))):
        assert (set(x) & set(y)) - {-1}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (399, 399)]
    want = roots(400, edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            y = x
            for _ in range(r.randrange(4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    at = {signed(x): i for i, x in enumerate(fps)}
    got = [(at[e.a], at[e.b]) for e in simhash.links(df).collect()]
    assert all(0 < (fps[a] ^ fps[b]).bit_count() <= 2 for a, b in got)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert roots(len(fps), got) == roots(len(fps), near)


def check(rows, out):
    prints = [plain_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(len(rows), near)
    least = {}
    for (doc, _), k in zip(rows, root):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    want = Counter((doc, f"{p:016x}", least.get(k)) for (doc, _), p, k in zip(rows, prints, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == want


def test_edges(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(70000))
    rows = [(9, None), (4, ""), (6, " \n"), (8, "One"), (2, "one"), (7, "a b"), (1, "A\tB"), (3, "a b c d É é"), (3, "a b c d É é")]
    rows += [(None, "only null"), (None, "only null"), (None, "a b"), (11, long), (12, long.upper()), (13, "É"), (14, "é")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp int")
    check(rows, simhash.near_duplicate_table(df).collect())
    kept = [tuple(r) for r in simhash.keep_first(df).collect()]
    assert Counter(r[0] for r in kept) == Counter([4, 2, 1, 3, 11, 13, 14, None])
    assert simhash.near_duplicate_table(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_first_rows_are_judged_by_their_own_text(spark):
    # Id 2 has a near copy of id 1 and a text of its own, id 3 a text twice, null ids a copy and a text of their own.
    rows = [(1, "a b c", 1), (2, "A b C", 2), (2, "quite another text", 3), (3, "thrice told tale", 5), (3, "thrice told tale", 4)]
    rows += [(None, "thrice told tale", 6), (None, "only here now", 7), (None, "only here now", 8)]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "doc_id long, text string, n int, tie string, first_id int, kept int")
    got = simhash.keep_first(df.repartition(3))
    assert got.columns == df.columns
    assert {(r.doc_id, r.n) for r in got.collect()} == {(1, 1), (2, 3), (3, 4), (None, 7)}


def test_given_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], simhash.near_duplicate_table(docs).collect())
