import hashlib
import math
import random
import zlib

import pytest

from tallyspark.llm import trie
from tallyspark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The rows of the trie, from all prefixes of all conversations."""
    convs = {}
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    nodes, children = {}, {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(nodes, key=len, reverse=True):
        below, members = children.get(s, []), nodes[s]
        leaves[s] = sum(leaves[x] for x in below) or 1
        saved[s] = sum(saved[x] for x in below) + (len(members) - 1) * (len(s[-1][1].encode().split()) if s else 0)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(s))
        parent = min(nodes[s[:-1]]) if s else None
        out.append((min(members), len(s), parent, len(members), len(below), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_tables(spark, folder):
    turns = table(spark, f"/root/testdata/{folder}", "conversations")
    assert collected(trie.trie_table(turns)) == plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed,piece,fan_in", [(1, 1, 2), (2, 2, 2), (3, 3, 64), (4, 7, 3), (5, 50, 2)])
def test_pieces_and_tasks(spark, seed, piece, fan_in):
    """Copies, prefixes, ties, nulls and turnless conversations, cut into pieces and tasks at any place."""
    r = random.Random(seed)
    rows = []
    for c in range(80):
        for k in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((r.choice([c, c, c, 3, None]), r.choice([k, k, k, None]), r.choice(["u", "a", None]), r.choice(["x y", "z", "", None])))
    rows += [(200 + i, k, "u", "all the same") for i in range(40) for k in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert collected(trie.prefix_trie(trie.rebuilt(turns), piece, fan_in)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_conversation_and_edges(spark):
    rows = [(c, k, "u", f"turn {k % 50}") for c in (20, 24, 41) for k in range(600)] + [(7, 0, None, "lone"), (-3, 0, "u", "below zero"), (7, 0, None, "lone")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", words string, n int")
    assert collected(trie.trie_table(turns)) == plain(rows)
    assert trie.trie_table(turns.limit(0)).collect() == []
    assert collected(trie.trie_table(spark.createDataFrame([(1, 0, "u", "a")], SCHEMA))) == plain([(1, 0, "u", "a")])
