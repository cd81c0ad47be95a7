import zlib

import numpy as np
import pytest

from tallyspark.llm import langid
from tallyspark.llm.common import documents

FOLDER = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, FOLDER)


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs)


def test_trigrams_are_the_letters_and_their_neighbours():
    column = ["Ab, c", None, "", "éa 1x", "!?", "ab,c"]
    buckets, counts = langid.trigrams(column)
    assert counts.tolist() == [3, 0, 0, 3, 0, 3]
    assert buckets[:3].tolist() == buckets[-3:].tolist()  # blanks and marks are the same edge
    alone = [langid.trigrams([t])[0].tolist() for t in column]
    assert [x for t in alone for x in t] == buckets.tolist()


def test_profiles_count_equal_trigrams_of_whole_texts(monkeypatch):
    odd = "ΟΔΥΣΣΕΥΣ İstanbul ß, naïve 漢字 a1b \n\tΣ"
    column = [odd * 40, None, "", odd, "x", "a" * 700, " " * 300, "word " * 200]
    want = [np.bincount(langid.trigrams([t])[0], minlength=langid.BUCKETS) for t in column]
    for size in (1 << 20, 500, 7, 1):
        monkeypatch.setattr(langid, "SLICE", size)
        for (buckets, counts), w in zip(langid.profiles(column), want, strict=True):
            assert np.array_equal(np.flatnonzero(w), buckets) and np.array_equal(w[w > 0], counts)


def test_held_out_accuracy(docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.language_table(docs).collect()
    assert len(out) == len(truth) and all(r.held_out == held(r.doc_id) for r in out)
    hit = [r.lang_pred == truth[r.doc_id] for r in out if r.held_out]
    assert len(hit) > 200 and np.mean(hit) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in r.languages for r in out)


def test_mixture_by_brute_force(model):
    r = np.random.default_rng(1)
    buckets = np.concatenate([r.choice(langid.BUCKETS, 3000, p=model.p[:, k].astype(float) / model.p[:, k].astype(float).sum()) for k in (0, 0, 1)])
    share, like = langid.Model.fitted(model.p[buckets][:, [0, 1]])
    grid = [(np.log(model.p[buckets][:, [0, 1]] @ [x, 1 - x]).sum(), x) for x in np.linspace(0.01, 0.99, 99)]
    best = max(grid)
    assert abs(share[0] - best[1]) < 0.02 and like >= best[0] - 1
    lang, score, chosen, fits = model.text(buckets)
    assert lang == model.languages[0] and set(chosen) == set(model.languages[:2]) and abs(score - best[1]) < 0.05 and fits


def test_one_language_stays_alone(model, docs):
    texts = [r.text for r in docs.filter("lang = 'fr' and n_chars > 500").select("text").collect()]
    assert np.mean([len(x[2]) == 1 for x in model.texts(texts)]) > 0.9


def test_edges(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "123 --- !"), (None, "the and of to"), (4, "x"), (5, "жйщ ъыь фхц ёюя " * 30), (6, "the of and was " * 40_000), (6, "the")]
    df = spark.createDataFrame([(*r, "zz", True) for r in rows], "doc_id long, text string, lang_pred string, fits boolean")
    out = {(r.doc_id, r.score): r for r in langid.predict(df, model).collect()}
    by = {i: [r for (d, _), r in out.items() if d == i] for i in (1, 2, 3, 4, 5, 6, None)}
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and not by[i][0].fits for i in (1, 2, 3))
    assert by[None][0].lang_pred == "en" and by[6][0].lang_pred == "en" and by[4][0].lang_pred in model.languages
    assert not by[5][0].fits
    assert langid.predict(df.limit(0), model).count() == 0
    kept = df.filter(langid.accepted(spark, df["text"], model))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 6, 6] and kept.columns == df.columns


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "7", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.language_table(df).collect()}
    assert {r.lang_pred for r in out.values()} == {"und"}
    assert [r.doc_id for r in langid.keep_languages(df).collect()] == [1]
    assert langid.language_table(df.limit(0)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(40) if held(i)][:5]
    rows = [(i, "zzz qqq", "held") for i in ids] + [(i, "abc abd", "seen") for i in range(40) if not held(i)]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["seen"]
