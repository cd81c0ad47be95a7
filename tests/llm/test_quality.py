import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality
from tallyspark.llm.common import documents, table

TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "one two",
    "a b c",
    "a b c a b c",
    "a a a a",
    "a b c d a b c x b c d",
    "line\nline\n line\n\n\nline\nother # * $ % & | < >\nother # * $ % & | < >",
    "é 😀 中文\x0bx\x0cy\rz \xa0q \x1cw",
    "word " * 3000,
    " ".join(f"w{i % 700}" for i in range(2000)),
    "a b c b c a b c b",
]


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)), words


def test_counts(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, grams int")
    out = {r.doc_id: tuple(r)[1:] for r in quality.with_counts(df.select("doc_id", "text")).drop("text", "grams").collect()}
    assert out == {i: plain(t)[0] for i, t in rows}


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.001"
    return documents(spark, folder), table(spark, folder, "labels")


def buckets(spark, words):
    grams = sorted({(w,) for w in words})
    df = spark.createDataFrame([(w,) for (w,) in grams] or [("",)], "w string").select("w", F.xxhash64("w").alias("h"))
    return {r.w: r.h for r in df.collect()}


def test_verdict_against_brute_force(spark, given):
    docs, labels = given
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cut = {i: plain(t)[1] for i, t in rows}
    h = buckets(spark, [w for ws in cut.values() for w in ws])
    pairs = sorted({(h[a], h[b]) for ws in cut.values() for a, b in zip(ws, ws[1:])})
    both = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    hh = {(r.a, r.b): r.h for r in both}
    grams = {i: [h[w] % quality.BUCKETS for w in ws] + [hh[h[a], h[b]] % quality.BUCKETS for a, b in zip(ws, ws[1:])] for i, ws in cut.items()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1} & set(grams)
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i in good for g in grams[i])
    k = quality.BUCKETS
    ratio = [math.log((target[b] + 1) / (target.total() + k)) - math.log((raw[b] + 1) / (raw.total() + k)) for b in range(k)]
    score = {i: sum(ratio[g] for g in x) / len(x) if x else 0.0 for i, x in grams.items()}
    ranked = sorted(score[i] for i in good)
    at = 0.01 * (len(ranked) - 1)
    threshold = ranked[int(at)] + (at - int(at)) * (ranked[int(at) + 1] - ranked[int(at)])
    for r in quality.quality_table(docs, labels).collect():
        counts = plain(dict(rows)[r.doc_id])[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert abs(r.score - score[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and score[r.doc_id] >= threshold - 1e-12)


def test_edges(spark):
    schema = "doc_id long, text string, words string, good int"
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "x", 1), (1, text, "x", 1), (2, text + " zz", "x", 1), (None, None, "x", 1), (3, "", "x", 1)], schema)
    out = sorted(quality.quality_table(df, labels).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.base_failed, r.kept) for r in out[1:3]] == [(1, False, True)] * 2
    assert [out[0].kept, out[4].kept] == [False, False] and len(out) == 5
    assert quality.quality_table(df.limit(0), labels).count() == 0
    out = quality.quality_table(df, labels.limit(0)).collect()
    assert Counter((r.doc_id, r.kept) for r in out) == Counter([(1, True), (1, True), (2, True), (3, False), (None, False)])


def test_all_trusted_rows_count(spark):
    n = 20_300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("w%d x%d y", F.col("id") % 97, F.col("id") % 89).alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "w1 x1 y"), (n, "w2 z")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).union(spark.createDataFrame([(n, 0), (None, 1)], "doc_id long, quality int"))
    trusted = quality.trusted_ids(labels)
    counts = quality.gram_counts(docs, trusted).agg(F.sum("raw"), F.sum("target")).first()
    assert tuple(counts) == (5 * n + 5 + 3, 5 * n)
    out = quality.quality(docs, labels)
    want = out.filter(f"doc_id < {n}").agg(F.percentile("score", quality.TRUSTED_LOSS)).first()[0]
    assert quality.score_quantile(out.join(trusted, "doc_id", "left_semi"), quality.TRUSTED_LOSS) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.01, 0.37, 0.5, 1.0])
def test_quantile(spark, q):
    for scores in ([0.25], [-1.5, 2.0], [i * i % 101 / 7 - 3 for i in range(230)], [0.1] * 50 + [0.1001] * 50):
        df = spark.createDataFrame([(x,) for x in scores], "score double")
        assert quality.score_quantile(df, q) == pytest.approx(df.agg(F.percentile("score", q)).first()[0], abs=1e-12)
    assert quality.score_quantile(df.limit(0), q) is None
