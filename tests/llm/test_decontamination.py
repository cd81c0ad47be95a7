import random
import re
from collections import Counter

import pytest

from tallyspark.llm import decontamination as d
from tallyspark.llm.common import documents, table


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def alike(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 0.0


def plain(docs, items, least=0.8):
    """Every window of every item's size, whether or not it begins where a shared shingle says."""
    found = {}
    cut = [(i, words(t)) for i, t in items]
    known = {}
    for i, w in cut:
        for g in grams(w):
            known.setdefault(g, set()).add(i)
    cut = dict(cut)
    for doc, t in docs:
        w = words(t)
        for i in {i for g in grams(w) for i in known.get(g, ())}:
            best = max(alike(grams(w[s : s + len(cut[i])]), grams(cut[i])) for s in range(max(1, len(w) - len(cut[i]) + 1)))
            if best >= least and doc is not None:
                found[doc, i] = max(best, found.get((doc, i), 0))
    return found


def test_given_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = documents(spark, folder), table(spark, folder, "benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in d.leaks(docs, items).collect()}
    assert got == pytest.approx(want) and len(want) > 10
    kept = {r.doc_id for r in d.drop_leaks(docs, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {k for k, _ in want}


def test_edited_passages(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(12, 90)))) for i in range(40)]
    docs = []
    for k in range(200):
        w = items[k % 40][1].split()
        for _ in range(k // 40):  # edit words, drop words, add words
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = r.choices(vocabulary, k=r.randrange(2))
        text = r.choices(vocabulary, k=r.randrange(100)) + w + r.choices(vocabulary, k=r.randrange(100))
        docs.append((k, r.choice([" ", ", ", "\n"]).join(text).upper()))
    want = plain(docs, items)
    sd = spark.createDataFrame(docs, "doc_id long, text string")
    si = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in d.leaks(sd, si).collect()}
    assert all(want[k] >= v - 1e-9 and v >= 0.8 for k, v in got.items())
    assert set(got) == set(want) and len(want) > 60


@pytest.mark.parametrize("limit", [0, 10**6])
def test_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", limit)
    item = "Alpha beta, gamma delta epsilon zeta! eta theta"
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "too short here"), (None, item), (6, "a a a a a a a a"), (6, "a a a a a a a a"), (6, "b c d e f g h i")]
    docs = [(1, "x " * 3000 + item.lower() + " y"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon"), (5, "too short here"), (None, item)]
    docs += [(6, "a " * 8), (7, "a " * 30), (8, "ALPHA-BETA_GAMMA 'delta' epsilon\nzeta eta theta"), (8, "other"), (8, "other"), (7, "a " * 30), (9, "x " * 50_000)]
    sd = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, item int, h string")
    si = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in d.leaks(sd, si).collect()}
    assert got == {(1, 1): (1.0, 3000), (1, 2): (1.0, 3000), (8, 1): (1.0, 0), (8, 2): (1.0, 0), (6, 6): (1.0, 0), (7, 6): (1.0, 0)}
    kept = d.drop_leaks(sd, si)
    assert kept.columns == sd.columns and sorted((x.doc_id, x.text[:5] if x.text else x.text) for x in kept.collect()) == [
        (2, None), (3, ""), (4, "alpha"), (5, "too s"), (8, "other"), (8, "other"), (9, "x x x")
    ]
    assert d.leaks(sd.limit(0), si).count() == 0 and d.leaks(sd, si.limit(0)).count() == 0


def test_all_fingerprints_within_the_radius_are_found(spark):
    r = random.Random(7)
    base = r.getrandbits(63)
    near = [base ^ sum(1 << b for b in r.sample(range(63), k)) for k in range(d.RADIUS + 1) for _ in range(20)]
    filed = {(x.block, x.value) for x in d._within(spark.createDataFrame([(1, base)], "item long, fp long")).collect()}
    assert len(filed) == d.BLOCKS * 697
    for x in near:
        assert any((k, x >> 16 * k & 0xFFFF) in filed for k in range(4))


def test_pairs_beyond_the_radius_are_found(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for k in range(400):
        w = r.choices(vocabulary, k=49)
        items.append((k, " ".join(w)))
        w[24] = "changed"
        docs.append((k, " ".join(r.choices(vocabulary, k=20) + w + r.choices(vocabulary, k=20))))
    want = plain(docs, items)
    sd, si = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in d.leaks(sd, si).collect()}
    assert got == pytest.approx(want) and len(want) == 400


@pytest.mark.parametrize("limit", [0, 10**6])
def test_crowded_items(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", limit)
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = r.choices(vocabulary, k=30)
    items = [(k, " ".join(shared + r.choices(vocabulary, k=r.randrange(4, 12)))) for k in range(60)]
    docs = [(k, " ".join(r.choices(vocabulary, k=20) + t.split()[: r.randrange(30, 42)] + r.choices(vocabulary, k=20))) for k, t in items]
    docs.append((60, "a b c d e f g h " + " ".join(["z"] * 36)))
    items.append((60, "a b c d e f g h " + " ".join(["z"] * 36)))
    want = plain(docs, items)
    sd, si = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in d.leaks(sd, si).collect()}
    assert got == pytest.approx(want) and len(want) > 20
