import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_round_trip(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 3000))
    ids = r.integers(0, 2**64, n, dtype=np.uint64) >> r.integers(0, 64, n, dtype=np.uint64)
    if seed % 2:
        ids = np.repeat(ids, 3) if seed == 1 else ids & np.uint64(0xFFFF)
    lengths = np.array([len(ids) // 2, 0, len(ids) - len(ids) // 2])
    got, back = tokens.read_segment(tokens.write_segment(lengths, ids))
    assert got.tolist() == lengths.tolist() and back.tolist() == ids.tolist()


def test_words_pack_the_most_ids_and_escapes_hold_any_id():
    words, first = tokens.encode(np.array([1] * 60 + [2**64 - 1, 0, 2**60 - 1, 2**60], np.uint64))
    assert [int(w >> np.uint64(60)) for w in words[:2]] == [1, 0] and int(words[2]) == 2**64 - 1
    assert first.tolist() == [0]
    assert tokens.decode(words, first, 64).tolist() == [1] * 60 + [2**64 - 1, 0, 2**60 - 1, 2**60]
    assert len(tokens.encode(np.zeros(0, np.uint64))[0]) == 0
    raw = np.full(600, 2**64 - 1 - 2**60, np.uint64)  # raw words look like any selector
    assert tokens.decode(*tokens.encode(raw), 600).tolist() == raw.tolist()
    low = np.full(600, 2**60, np.uint64)
    low[::2] = 2**63 + 1
    assert tokens.decode(*tokens.encode(low), 600).tolist() == low.tolist()


TEXTS = [
    "Plain words, with punctuation!! And MORE...",
    "it's we'll I'M 'sound don't",
    "naïve Éréier  İstanbul ǅ ﬁne éclair ́ á",
    "digits 123 4a5 a1b2 x.y.z u_v <|endoftext|> a<|startoftext|>b <|x|>",
    "emoji 😀😀 👩‍👩‍👧 中文字 한국어 가 K",
    "tabs\tand\x0bother\x0c\r\nspace \x1c \x85   gap gap",
    "ΟΔΟΣ Σ ΣΑΣ, ŉ ß ẞ½ x² ǆ Ω Å",
    "\x00nul a\x00b ###$$$ |pipe| 100% %%% _under_",
    "",
    " \n ",
    None,
]


@pytest.mark.parametrize("remembered", [0, 3, 1000])
def test_ids_are_those_of_the_library(monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    monkeypatch.setattr(tokens, "SLICE", 50)
    t = Tokenizer.from_file(PATH)
    got = [ids.tolist() for ids in tokens.Words(PATH).column(pa.array(TEXTS).slice(1))]
    got.insert(0, next(tokens.Words(PATH).column(pa.array(TEXTS))).tolist())
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_documents_round_trip(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i * 3, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "none"), (7, "twice a"), (7, "twice a"), (1000, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    segments = tokens.write_tokens(df, PATH, segment_ids=100)
    got = {}
    total = 0
    for r in sorted(tokens.read_tokens(segments).collect(), key=lambda r: r.start):
        assert r.start == total and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        total += r.n_tokens
        got.setdefault(r.doc_id, []).append(r.ids[:-1])
    ids = [r.doc_id for r in sorted(tokens.read_digests(segments).collect(), key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda v: (v is not None, v)) and len(ids) == len(rows)
    for i, text in rows:
        assert t.encode(text or "", add_special_tokens=False).ids in got[i]
    for r in tokens.read_digests(segments).collect():
        if r.doc_id == 1000:
            assert r.ids_crc32 == zlib.crc32(np.array(got[1000][0] + [1], "<u4").tobytes())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_digests(tokens.write_tokens(empty, PATH)).count() == 0
