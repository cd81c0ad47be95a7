import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import lines
from tallyspark.llm.common import documents


def plain(rows):
    """(text that stays, removed line numbers) of each row; rows are in order, equal rows count as one."""
    seen, out = [], {}
    first = {}
    by_word = {}
    for d, r in enumerate(rows):
        d = first.setdefault(r, d)
        if d in out:
            continue
        gone = []
        for i, line in enumerate((r[1] or "").split("\n")):
            s = frozenset("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).encode().split())
            if not s:
                continue
            near = {j for w in s for j in by_word.get(w, ())}
            if any(len(s & seen[j]) * 5 >= len(s | seen[j]) * 4 for j in near):
                gone.append(i)
            for w in s:
                by_word.setdefault(w, []).append(len(seen))
            seen.append(s)
        out[d] = gone
    return [(r[0], out[first[r]]) for r in rows]


def check(df, rows):
    want = Counter((i, tuple(g)) for i, g in plain(rows))
    got = lines.line_table(df).collect()
    assert Counter((r.doc_id, tuple(r.removed)) for r in got) == want
    assert all(r.n_removed == len(r.removed) for r in got)


@pytest.mark.parametrize("seed,group,hot,buckets", [(1, 64, 1 << 14, 1 << 22), (2, 3, 1 << 14, 1 << 22), (3, 2, 4, 1 << 22)])
def test_random_lines(spark, monkeypatch, seed, group, hot, buckets):
    monkeypatch.setattr(lines, "GROUP", group)
    monkeypatch.setattr(lines, "HUBS", 1)
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(seed)
    base = [[f"w{min(r.randrange(300), r.randrange(300))}" for _ in range(r.randrange(1, 40))] for _ in range(40)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(r.randrange(6)):
            line = list(r.choice(base))
            for _ in range(r.randrange(6)):
                line[r.randrange(len(line))] = f"w{r.randrange(300)}"
            r.shuffle(line)
            text.append(" ".join(line).upper() if r.random() < 0.1 else "\t".join(line))
        rows.append((i, "\n".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_given_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])


def test_edges(spark):
    a, b = "a b c d e f g h i j", "J i h g f e d c b A a"
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, a), (1, None), (2, ""), (3, f"{a}\n\n{b}\nshort line\nshort line"), (4, "short line"), (5, long), (6, long + " more\r"), (7, "x y z u v"), (8, "x y z u v w"), (9, "x y z u v")]
    rows += [(10, "p q r s t\n" * 3), (10, "p q r s t\n" * 3)]
    df = spark.createDataFrame([(*r, "T", 3) for r in rows], "doc_id long, text string, tie string, line int")
    check(df, rows)
    kept = lines.dedup_lines(df)
    out = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == df.columns and out[3].text == "\nshort line" and out[2].text == "" and out[1].text is None
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 10, 10]
    assert lines.line_table(df.limit(0)).count() == 0 and lines.dedup_lines(df.limit(0)).count() == 0


def test_short_lines(spark):
    """Sets of 1 to 3 words meet equal ones only, a set of 4 also one of 5 with all its words."""
    rows = [(1, "All rights\nall RIGHTS\nmenu\na b c\nc b a d"), (2, "menu\nrights all all\na b c d e\na b"), (3, "The The The\nthe\nmenu home\nb c d e a"), (4, "a d b\n\n \n")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows)
    assert plain(rows) == [(1, [1]), (2, [0, 1, 2]), (3, [1, 3]), (4, [])]


def test_sets_are_in_one_order():
    rare = np.zeros(lines.BUCKETS, np.uint8)
    s = lines.Sets([b"b a b c", b"", b"c b a"], rare)
    assert s.size.tolist() == [3, 0, 3] and s.h[:3].tolist() == s.h[3:].tolist()
    assert s.sums(1)[0] == s.sums(1)[2] != s.sums(1)[1] and s.parity()[0] == s.parity()[2]


@pytest.mark.parametrize("most,pairs", [(1000, 1 << 17), (1000, 1), (3, 50)])
def test_compared_loses_no_similar_pair(monkeypatch, most, pairs):
    """Every pair of similar sets meets under some word, or both are members of a group that is too large."""
    monkeypatch.setattr(lines, "PAIRS", pairs)
    r = random.Random(most + pairs)
    base = [[f"w{r.randrange(200)}" for _ in range(r.randrange(4, 40))] for _ in range(12)]
    texts = sorted({" ".join(sorted(set(r.sample(b, len(b) - r.randrange(2)) + [f"w{r.randrange(200)}"]))) for b in base for _ in range(8)})
    rare = np.ones(lines.BUCKETS, np.uint8)
    s = lines.Sets([t.encode() for t in texts], rare)
    use = np.flatnonzero(s.place < (s.size - (4 * s.size + 4) // 5 + 1)[s.line])
    line = s.line[use]
    c = {"word": (s.h[use] >> np.uint64(32)).astype(np.int64), "id": line.astype(np.int64), "parity": s.parity(0)[line], "more": s.parity(1)[line], "size": s.size[line], "at": s.place[use]}
    order = np.lexsort((c["size"], c["word"]))
    met, large = set(), {}
    for found in lines._compared({k: v[order] for k, v in c.items()}, most):
        if "a" in found:
            met |= set(zip(found["a"].tolist(), found["b"].tolist()))
        else:
            for w, i in zip(found["word"].tolist(), found["id"].tolist()):
                large.setdefault(w, set()).add(i)
    words = [set(t.split()) for t in texts]
    similar = [(i, j) for j in range(len(texts)) for i in range(j) if len(words[i] & words[j]) * 5 >= len(words[i] | words[j]) * 4]
    assert similar and all(i < j for i, j in met) and bool(large) == (most == 3)
    assert all(p in met or any(p[0] in g and p[1] in g for g in large.values()) for p in similar)


def test_near_copies_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Of n lines that all resemble each other, n - 1 pairs are verified, and all but the first line go."""
    seen, verified = [], lines._verified

    def count(pairs, rows, places):
        seen.append(pairs.count())
        return verified(pairs, rows, places)

    monkeypatch.setattr(lines, "_verified", count)
    common = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{common} own{i}") for i in range(30)], "doc_id long, text string")
    assert sorted((r.doc_id, r.removed) for r in lines.line_table(df).collect()) == [(i, [0] if i else []) for i in range(30)]
    assert seen == [29, 0]


def test_near_copies_are_not_sent_pair_by_pair(spark, monkeypatch):
    """Of n lines that all resemble each other no step writes more rows than there are lines, hot words included."""
    staged = lines.staged
    for hot in (1 << 14, 4):
        sizes = {}

        def count(df, label):
            out = staged(df, label)
            sizes[label] = max(sizes.get(label, 0), out.count())
            return out

        monkeypatch.setattr(lines, "staged", count)
        monkeypatch.setattr(lines, "HOT", hot)
        common = " ".join(f"w{i}" for i in range(40))
        df = spark.createDataFrame([(i, f"{common} own{i}") for i in range(60)], "doc_id long, text string")
        assert sorted((r.doc_id, r.removed) for r in lines.line_table(df).collect()) == [(i, [0] if i else []) for i in range(60)]
        assert max(n for label, n in sizes.items() if label not in ("rarity", "hot")) <= 60


@pytest.mark.parametrize("most", [1000, 3])
def test_sets_that_are_not_settled_meet_all_others(spark, monkeypatch, most):
    """The earliest candidate shares the filters' view but not enough words; a later one does."""
    monkeypatch.setattr(lines, "GROUP", most)
    monkeypatch.setattr(lines, "HUBS", 1)
    monkeypatch.setattr(lines.Sets, "parity", lambda self, half=0: np.zeros(len(self.size), np.uint64))
    base = [f"w{i}" for i in range(30)]
    near = lambda out, into: " ".join([w for w in base if w not in out] + into)
    rows = [(i, near(base[20 + i : 24 + i], [f"a{i}{k}" for k in range(4)])) for i in range(6)]
    rows += [(10, near(base[:2], ["x", "y"])), (11, near(base[:2], ["x", "z"])), (12, near(base[:3], ["x", "z"]))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows)


def sizes_of(monkeypatch):
    """The rows of each frame that ``lines`` stages, by label."""
    staged, sizes = lines.staged, {}

    def count(df, label):
        out = staged(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(lines, "staged", count)
    return sizes


@pytest.mark.parametrize("most", [8, 1])
def test_next_candidates_are_at_hand(spark, monkeypatch, most):
    """The closest candidate does not settle a set, the next one does: prefix words are brought once more only if there are
    more candidates than a task sends."""
    sizes = sizes_of(monkeypatch)
    monkeypatch.setattr(lines, "NEAREST", most)
    base = [f"w{i}" for i in range(90)]

    def near(begin, n, apart):
        """``base`` with n words replaced, so that the parity bits tell 2 n words apart but for collisions."""
        for seed in range(1000):
            text = " ".join([*base[:begin], *(f"own{seed}n{i}" for i in range(n)), *base[begin + n :]])
            s = lines.Sets([text.encode(), " ".join(base).encode()], np.ones(lines.BUCKETS, np.uint8))
            if sum(int(x[0] ^ x[1]).bit_count() for x in (s.parity(0), s.parity(1))) == apart:
                return text

    rows = [(0, near(0, 12, 16)), (1, near(40, 10, 20)), (2, " ".join(base))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows)
    assert plain(rows) == [(0, []), (1, []), (2, [0])] and sizes["unsettled"] == 1 and (sizes["mine"] == 0) == (most == 8)


def test_hot_words_of_few_sets_are_compared_at_once(spark, monkeypatch):
    """Two lines that are not similar, each in many documents: their words are hot in the corpus, but two sets have them."""
    sizes = sizes_of(monkeypatch)
    monkeypatch.setattr(lines, "HOT", 4)
    common = " ".join(f"w{i}" for i in range(10))
    rows = [(i, " ".join([common, *(f"own{i % 2}{k}" for k in range(4))])) for i in range(12)] + [(20, f"{common} own00 own01 own02")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert sizes["hot"] > 0 and sizes["mine"] == 0


def test_bitmaps_follow_the_rows(spark):
    """No row of the set is lost, few others pass, and a few rows do not take a bitmap of the largest size."""
    rows = spark.range(20_000).selectExpr("id AS doc", "0L AS tie", "1 AS line")
    few = lines.staged(rows.filter("doc % 1000 = 0"), "few")
    marked = lines._marked(rows, few)
    assert marked.join(few, lines.PLACE).count() == 20 and marked.count() < 1500
    assert marked.select("doc").distinct().count() == marked.count()
    assert str(lines.LINE_BITS) not in marked._jdf.queryExecution().toString()


def test_lines_are_cut_without_python(spark):
    """No worker holds a batch of texts to cut lines out of them; trailing and empty lines stay as they are."""
    rows = [(1, "a\n\nb\n", [0]), (2, "a\nb", [0, 1]), (3, None, None), (4, "x\r\ny", [1]), (5, "\nz\n\n", None), (6, "\n\nq r", [2])]
    out = lines._without(spark.createDataFrame(rows, "doc long, text string, gone array<int>"))
    assert [r.text for r in out.orderBy("doc").collect()] == ["\nb\n", "", None, "x\r", "\nz\n\n", "\n"]
    kept = lines.dedup_lines(spark.createDataFrame([(1, "p q r s"), (2, "s r q p\nt u")], "doc_id long, text string"))
    assert [r.text for r in kept.orderBy("doc_id").collect()] == ["p q r s", "t u"] and "Python" not in kept._jdf.queryExecution().executedPlan().toString()
