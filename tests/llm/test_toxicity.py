import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import toxicity
from tallyspark.llm.common import documents, table

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given(spark):
    return documents(spark, FOLDER), table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def model(given):
    return toxicity.learn(*given)


def test_held_out(given, model):
    docs, labels = given
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in toxicity.toxicity_table(docs.join(labels.select("doc_id"), "doc_id"), labels).collect() if r.held_out]
    assert len(out) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in out)
    hits = sum(r.predicted and truth[r.doc_id] for r in out)
    assert hits / sum(truth[r.doc_id] for r in out) > 0.8 and hits / sum(r.predicted for r in out) > 0.9


def test_sentences_and_scores_go_together(model):
    texts = ["One two. Three!\nfour five? six\n\n. \nA.b c...", "", None, " \n ", "x", "scum.", "a\x1cb.\x85c", "e.g. this: 1.5 is. fine"]
    for t in texts:
        assert len(model.sentence_scores(t)) == len(list(toxicity.sentences(t or "")))
        by_hand = []
        for s in toxicity.sentences(t or ""):
            z = model.bias + sum(model.weights.get(f, 0) for w in s.split() for f in toxicity.features(w))
            by_hand.append(1 / (1 + np.exp(-z)))
        assert np.allclose(model.sentence_scores(t), by_hand)
        assert abs(model.score(t) - (1 - np.prod(1 - np.array(by_hand)))) < 1e-9


def test_gradient_reaches_the_noisy_or_optimum():
    # One feature decides; every bag has neutral sentences besides.
    texts = [f"plain words here. {'vile' if i % 2 else 'mild'} thing. more words" for i in range(200)]
    m = toxicity.fit(texts, [i % 2 for i in range(200)], np.ones(200))
    assert m.score(texts[1]) > 0.9 and m.score(texts[0]) < 0.1
    s = m.sentence_scores(texts[1])
    assert s.argmax() == 1 and s[0] < 0.1 and s[2] < 0.1


def test_offending_sentences(spark, model):
    df = spark.createDataFrame([(1, "It was on the of. You idiot scum, trash loser! The end."), (2, "the of and"), (3, None)], "doc_id long, text string")
    out = toxicity.offending(df, model).collect()
    assert [(r.doc_id, r.sentence, r.text) for r in out] == [(1, 1, "You idiot scum, trash loser!")]


def test_edges(spark, given, model):
    _, labels = given
    rows = [(1, None), (2, ""), (3, " \n."), (None, "idiot scum trash loser"), (5, "word " * 200_000), (5, "x")]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, toxic int")
    out = toxicity.score(df, model).collect()
    assert sorted((r.doc_id or 0, r.n_sentences, r.score > 0.3) for r in out) == [(0, 1, True), (1, 0, False), (2, 0, False), (3, 1, False), (5, 1, False), (5, 1, False)]
    assert toxicity.toxicity_table(df.limit(0), labels).count() == 0
    none = toxicity.toxicity_table(df, labels.limit(0)).collect()
    assert len(none) == 6 and all(r.predicted == 0 and r.score < 0.01 for r in none)


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "vile" if i in ids else "mild and plain") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in ids)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    assert not toxicity.learn(docs, labels).weights


def test_a_long_text_does_not_end_the_sample(spark):
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = {i: "plain vile thing" if i % 2 else "plain mild thing" for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    whole = toxicity.learn(docs, labels).weights
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    first = [min((i for i in ids if i % 2 == k), key=hashes.get) for k in (0, 1)]
    long = docs.withColumn("text", F.when(F.col("doc_id").isin(first), F.concat("text", F.lit(" plain" * 10_000))).otherwise(F.col("text")))
    m = toxicity.learn(long, labels, sample_bytes=20_000)
    assert whole and m.weights and m.score("plain vile thing") > 0.9 and m.score("plain mild thing") < 0.1


def test_texts_that_fit():
    rows = [{"toxic": 0, "rank": k, "h": k, "bytes": b, "n": 1} for k, b in [(1, 5), (2, 90), (3, 4), (4, 2), (5, 1)]]
    rows += [{"toxic": 1, "rank": k, "h": k, "bytes": b, "n": 1} for k, b in [(1, 90), (2, 80)]]
    assert toxicity.fitting(rows, 10) == [(0, 1, 1), (0, 3, 3), (0, 5, 5), (1, 2, 2)]
