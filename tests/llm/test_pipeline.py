from collections import Counter

import corpus_pipeline
from test_decontamination import plain as plain_leaks
from test_lines import plain as plain_lines
from test_simhash import plain_print, roots

from tallyspark.llm import langid, packing
from tallyspark.llm.common import documents, table

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_stages_against_brute_force(spark):
    docs = documents(spark, FOLDER)
    columns, before = docs.columns, rows(docs)
    model = langid.learn(docs)
    now = [r for r, x in zip(before, model.texts([r[1] for r in before])) if x[3]]
    stages = dict(corpus_pipeline.STAGES)
    got = stages["language_id"](spark, docs, FOLDER)
    assert got.columns == columns and rows(got) == now

    def frame():
        return spark.createDataFrame(now, docs.schema).repartition(3)

    after = []
    for r, (_, gone) in zip(now, plain_lines([r[:2] for r in now])):
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        if not gone:
            after.append(r)
        elif text.encode().split():
            after.append((r[0], text, r[2], r[3], len(text)))
    got = stages["line_dedup"](spark, frame(), FOLDER)
    assert got.columns == columns and rows(got) == after
    now = after

    prints = [plain_print(r[1]) for r in now]
    root = roots(len(now), [(i, j) for i in range(len(now)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    after = [r for i, r in enumerate(now) if root[i] == i]
    got = stages["simhash_near_dedup"](spark, frame(), FOLDER)
    assert got.columns == columns and rows(got) == after
    now = after

    leaked = {i for i, _ in plain_leaks([r[:2] for r in now], [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()])}
    after = [r for r in now if r[0] not in leaked]
    got = stages["benchmark_decontamination"](spark, frame(), FOLDER)
    assert got.columns == columns and rows(got) == after
    now = after

    packed = rows(packing.pack_documents(frame()))
    words = {r[0]: len(r[1].encode().split()) for r in now}
    total = Counter()
    for r in packed:
        total[r[0]] += r[3]
    assert dict(total) == words
    assert rows(corpus_pipeline.run(spark, FOLDER)) == packed


def test_empty_tables(spark):
    docs = documents(spark, FOLDER).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name
