"""Language identification as inference of a mixture.

Each language is a distribution over letter trigrams (hashed to ``BUCKETS``), learned from labelled texts. A text's
trigrams are taken as drawn from a mixture of languages, whose proportions are found by expectation-maximisation.
Languages enter the text's set one by one, in the order of their proportions, as long as the likelihood of the refitted
mixture gains more than a penalty for each. The prediction is the largest part of the chosen mixture. Equal trigrams of a
text are one row with a count, so a text of any length takes BUCKETS rows at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, fold, held_out, smallest, staged

BUCKETS = 1 << 16
#: Texts learned from, per language: those with the smallest hash of their id. Bounds the broadcast of chosen ids.
SAMPLE = 2000
SMOOTHING = 0.5
ROUNDS = 20
#: Trigrams overlap, so three of them count as one observation in the penalty.
PENALTY = 3.0
#: A further language must also explain this share of a nat per letter more.
LEAST_GAIN = 0.002
#: A text is foreign if chance explains it better by so many nats.
FOREIGN = 20.0
UNKNOWN = "und"
SLICE = 1 << 20
LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _hashed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where letters are, and a bucket for each (the letter and its neighbours, which count as blank if they are no letters).

    The first and the last code are neighbours only.
    """
    letter = LETTER[code]
    code = np.where(letter, code, np.uint32(0))
    at = np.flatnonzero(letter[1:-1]) + 1
    h = code[at - 1] * np.uint32(0x9E3779B1) ^ code[at] * np.uint32(0x85EBCA77) ^ code[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return at, (h >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(column: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each letter, and the number of letters of each text."""
    low = [(t or "").lower() for t in column]
    at, buckets = _hashed(_code(" ".join(["", *low, ""])))
    ends = np.cumsum([1] + [len(t) + 1 for t in low])
    return buckets, np.diff(np.searchsorted(at, ends))


def profiles(column: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different buckets of each text, and how many letters have each.

    Texts of more than SLICE characters are counted piece by piece, so their letters are never laid out at once.
    """
    buckets, counts = trigrams([t if t and len(t) <= SLICE else None for t in column])
    for text, own in zip(column, np.split(buckets, np.cumsum(counts)[:-1])):
        if text and len(text) > SLICE:
            low = f" {text.lower()} "
            seen = np.zeros(BUCKETS, np.int64)
            for begin in range(0, len(low) - 2, SLICE):
                seen += np.bincount(_hashed(_code(low[begin : begin + SLICE + 2]))[1], minlength=BUCKETS)
            found = np.flatnonzero(seen)
            yield found.astype(np.int32), seen[found]
        else:
            yield np.unique(own, return_counts=True)


class Model:
    """Probabilities (buckets x languages) of the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = ((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
        self.log = np.log(self.p)

    @staticmethod
    def fitted(p: np.ndarray, times: np.ndarray | int = 1) -> tuple[np.ndarray, float]:
        """Proportions of the mixture, and its log-likelihood; ``times`` says how often each row of ``p`` was seen."""
        times = np.full(len(p), times, np.float32)
        part, n = np.full(p.shape[1], 1 / p.shape[1], np.float32), np.float32(times.sum(dtype=np.float64))
        for _ in range(ROUNDS):
            part = part * ((times / (p @ part)) @ p) / n
        return part / part.sum(), float((np.log(p @ part) * times).sum(dtype=np.float64))

    def text(self, buckets: np.ndarray, counts: np.ndarray | int = 1) -> tuple[str, float, list[str], bool]:
        """Language, its share, the chosen set, and whether chance does not explain the text far better than the set."""
        times = np.full(len(buckets), counts, np.float32)
        n = int(times.sum(dtype=np.float64))
        if not n:
            return UNKNOWN, 0.0, [], False
        if not self.languages:
            return UNKNOWN, 0.0, [], True
        single = (self.log[buckets] * times[:, None]).sum(axis=0, dtype=np.float64)
        p = self.p[buckets]
        share, bound = self.fitted(p, times)
        chosen, part, like = [int(single.argmax())], share, float(single.max())
        cost = PENALTY * 0.5 * np.log(max(n, 2)) + LEAST_GAIN * n
        # No set's likelihood exceeds that of all languages together.
        if bound - like > cost:
            order = np.argsort(-share, kind="stable")
            for k in range(2, len(order) + 1):
                more, gained = self.fitted(p[:, order[:k]], times)
                if gained - like <= cost * (k - len(chosen)):
                    break
                chosen, like = order[:k].tolist(), gained
                part = np.zeros(len(share), np.float32)
                part[chosen] = more
        best = max(chosen, key=lambda i: part[i])
        return self.languages[best], float(min(1.0, part[best])), [self.languages[i] for i in chosen], bool(like > -n * np.log(BUCKETS) - FOREIGN)

    def texts(self, column: list[str | None]) -> list[tuple[str, float, list[str], bool]]:
        return [self.text(*profile) for profile in profiles(column)]


def _slices(column: pa.Array | pd.Series) -> Iterator[list[str | None]]:
    held, size = [], 0
    for value in column:
        text = value.as_py() if isinstance(value, pa.Scalar) else value
        held.append(text if isinstance(text, str) else None)
        size += len(held[-1] or "")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from doc_id, text and lang of the rows that are not held out.

    Of each language the ``sample`` rows with the smallest hash of their id are taken, whole. Rows without id, text or
    language teach nothing.
    """
    rows = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (fold("doc_id") != 2))
    chosen = staged(smallest(rows, "lang", "doc_id", F.lit(sample)).select("doc_id").distinct(), "chosen")
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter("lang is not null and text is not null")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        languages, seen = iter(batch.column(1).to_pylist()), {}
        for held in _slices(batch.column(0)):
            for (buckets, counts), lang in zip(profiles(held), languages):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += counts
        for lang, counts in seen.items():
            found = np.flatnonzero(counts)
            yield {"lang": [lang] * len(found), "bucket": found.astype(np.int32), "n": counts[found]}

    counted = by_batch(texts.select("text", "lang"), work, "lang string, bucket int, n long")
    # Languages x BUCKETS rows at most, whatever the corpus.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found.column("bucket").to_numpy(), [number[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the prediction's share of the text), languages (the chosen set) and fits of each row.

    A text that is null or has no letter is ``und`` with score 0 and no languages. fits: trigrams drawn at random do
    not explain the text far better than the chosen mixture.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out = [x for held in _slices(batch.column(1)) for x in shared.value.texts(held)]
        lang, score, languages, fits = zip(*out) if out else ((), (), (), ())
        yield {"doc_id": batch.column(0), "lang_pred": lang, "score": score, "languages": languages, "fits": fits}

    schema = "doc_id long, lang_pred string, score double, languages array<string>, fits boolean"
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def accepted(spark: SparkSession, text: Column, model: Model) -> Column:
    """Whether a text has letters and one of the languages: what a corpus filter keeps."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def keep(column: pd.Series) -> pd.Series:
        return pd.Series([x[3] for held in _slices(column) for x in shared.value.texts(held)], dtype=bool)

    return keep(text)


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; rows without a text or a letter go."""
    return docs.filter(accepted(docs.sparkSession, F.col("text"), learn(docs)))


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of each row, with a model of the rows that are not held out."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")
