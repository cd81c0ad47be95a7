"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words and the beginnings of its words; the
document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents carry labels: the likelihood of the
labels under the noisy-or trains the sentence scores, which then locate the sentences that make a document toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fold, held_out, smallest, staged

#: Labelled rows learned from, per class: those with the smallest hash of their id, up to so many rows and bytes; a
#: text that does not fit into the bytes left is passed over.
SAMPLE, SAMPLE_BYTES = {0: 4000, 1: 2000}, 24_000_000
#: Lengths of the beginnings of words that are features beside the word.
STEMS = (4, 5, 6, 7, 8)
#: Features enter if they are in so many documents of the sample and go with its labels this closely (likelihood-ratio
#: statistic of feature and label; 15 is exceeded by chance once in 10,000).
LEAST, ASSOCIATED = 4, 15.0
ROUNDS, RATE, DECAY = 300, 0.1, 0.05
THRESHOLD = 0.3
#: Words whose weight a worker remembers before it starts anew.
REMEMBERED = 600_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Marks the last word of a sentence in a list of weights.
STOP = 1e6


def sentences(text: str) -> Iterator[str]:
    """Lines, cut behind words that end in a full stop, question or exclamation mark."""
    for line in text.split("\n"):
        start = 0
        for m in re.finditer(r"[.!?]+(?=\s|$)", line):
            if line[start : m.end()].strip():
                yield line[start : m.end()].strip()
            start = m.end()
        if line[start:].strip():
            yield line[start:].strip()


def features(word: str) -> list[str]:
    stem = EDGE.sub("", word.lower())
    return [stem, *(stem[:n] + "+" for n in STEMS if len(stem) > n)] if stem else []


class Model:
    """Weights of features, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word)) + STOP * word.endswith((".", "!", "?"))
        return value

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """A score for each sentence of the text, in order."""
        values: list[float] = []
        ends: list[int] = []
        for line in (text or "").split("\n"):
            values += map(self._word, line.split())
            ends.append(len(values))
        if not values:
            return np.zeros(0)
        weight = np.array(values)
        last = weight > STOP / 2
        weight[last] -= STOP
        last[np.array(ends)[np.array(ends) > 0] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(weight, starts) + self.bias, -30, 30)))

    def score(self, text: str | None) -> float:
        """The noisy-or of the sentences; 0 without sentences."""
        return float(-np.expm1(np.log1p(-np.minimum(self.sentence_scores(text), 1 - 1e-12)).sum()))


def associated(texts: list[str], y: np.ndarray) -> dict[str, int]:
    """Numbers for the features that go with the labels of the texts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, y.tolist()):
        seen[label].update({f for word in set(text.split()) for f in features(word)})
    names = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= LEAST]
    names.sort()
    b, a = (np.array([c[f] for f in names], float) for c in seen)
    q, p = (max(1, int((y == k).sum())) for k in (0, 1))

    def part(found: np.ndarray, of: np.ndarray) -> np.ndarray:
        return found * np.log(np.maximum(found, 1e-9) / np.maximum(of, 1e-9))

    share = (a + b) / (p + q)
    g = 2 * (part(a, p * share) + part(b, q * share) + part(p - a, p * (1 - share)) + part(q - b, q * (1 - share)))
    return {names[i]: k for k, i in enumerate(np.flatnonzero(g >= ASSOCIATED))}


def fit(texts: list[str], labels: list[int], weights: np.ndarray) -> Model:
    """Maximum likelihood of the document labels, with decayed weights of the features that go with the labels; the same
    rows give the same model."""
    y, w = np.asarray(labels, int), np.asarray(weights, float)
    number = associated(texts, y)
    feature: list[int] = []
    sentence: list[int] = []
    owner: list[int] = []
    for d, text in enumerate(texts):
        for s in sentences(text):
            for word in s.split():
                found = [number[f] for f in features(word) if f in number]
                feature += found
                sentence += [len(owner)] * len(found)
            owner.append(d)
    if not owner:
        return Model({}, -30.0)
    idx, sent, own = np.array(feature, int), np.array(sentence, int), np.array(owner, int)
    n = len(number)
    theta, bias = np.zeros(n), -4.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.clip(np.bincount(sent, theta[idx], len(own)) + bias, -30, 30)
        total = np.bincount(own, np.logaddexp(0, z), len(texts))  # -log of the chance that no sentence is toxic
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0) * w / w.sum()
        g = slope[own] / (1 + np.exp(-z))
        grad = np.bincount(idx, g[sent], n) + DECAY / len(texts) * theta
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        theta -= rate * m / (np.sqrt(v) + 1e-9)
        bias -= rate * mb / (vb**0.5 + 1e-9)
    return Model({f: float(x) for f, x in zip(number, theta) if abs(x) > 1e-3}, bias)


def fitting(sizes: list[dict], most: int) -> list[tuple[int, int, int]]:
    """(toxic, rank, h) of the texts that are learned from: each class's, by rank, that fit into what the ones before
    leave of ``most`` bytes. If none of a class fits, its smallest is taken.

    ``sizes`` has toxic, rank, h, bytes and n (rows of that text).
    """
    out = []
    for label in (0, 1):
        rows = sorted((s for s in sizes if s["toxic"] == label), key=lambda s: (s["rank"], s["h"]))
        left, taken = most, []
        for s in rows:
            if s["bytes"] * s["n"] <= left:
                left -= s["bytes"] * s["n"]
                taken.append(s)
        taken = taken or sorted(rows, key=lambda s: s["bytes"] * s["n"])[:1]
        out += [(label, s["rank"], s["h"]) for s in taken]
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows that are not held out: of each class, the rows with the smallest hash of their id.

    Rows count for as many as their class has; rows without id or text teach nothing.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    marks = marks.filter(fold("doc_id") != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    most = F.when(F.col("toxic") == 1, sample[1]).otherwise(sample[0])
    chosen = staged(smallest(marks, "toxic", "doc_id", most), "labelled")
    totals = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "toxic", "rank", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("toxic", "rank", "h").agg(F.max(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).toArrow()
    fits = rows.sparkSession.createDataFrame(fitting(sizes.to_pylist(), sample_bytes), "toxic int, rank int, h long")
    found = rows.join(F.broadcast(fits), ["toxic", "rank", "h"]).select("text", "toxic", "rank").toArrow()
    order = np.lexsort((found.column("rank").to_numpy(), found.column("toxic").to_numpy()))
    texts, y = found.column("text").to_pylist(), found.column("toxic").to_numpy()
    count = np.bincount(y, minlength=2)
    weight = np.array([totals.get(k, 0) / max(1, count[k]) for k in (0, 1)])
    return fit([texts[i] for i in order], [int(y[i]) for i in order], weight[y[order]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; 0 for a null or empty text), the number of sentences and the worst one (number from 0, and its score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"score": [], "n_sentences": [], "worst": [], "worst_score": []}
        for value in batch.column(1):
            s = shared.value.sentence_scores(value.as_py())
            out["score"].append(float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum())))
            out["n_sentences"].append(len(s))
            out["worst"].append(int(s.argmax()) if len(s) else None)
            out["worst_score"].append(float(s.max()) if len(s) else None)
        yield {"doc_id": batch.column(0), **out}

    schema = "doc_id long, score double, n_sentences int, worst int, worst_score double"
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def offending(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """One row per sentence that scores ``least`` or more: doc_id, sentence (number from 0), text, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"doc_id": [], "sentence": [], "text": [], "score": []}
        for doc_id, value in zip(batch.column(0), batch.column(1)):
            text = value.as_py()
            scores = shared.value.sentence_scores(text)
            if (hit := np.flatnonzero(scores >= least)).size:
                parts = list(sentences(text))
                for i in hit:
                    for k, v in zip(out, (doc_id.as_py(), int(i), parts[i], float(scores[i]))):
                        out[k].append(v)
        yield out

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, sentence int, text string, score double")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on), n_sentences, worst of each row."""
    found = score(docs, learn(docs, labels))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst"
    )
