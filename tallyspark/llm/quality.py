"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams between trusted texts and the corpus.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets. Two multinomials over the buckets are counted,
one from the trusted documents and one from the whole corpus, both smoothed. A document's score is the log-likelihood
ratio of its n-grams, divided by their number. A document passes if its score is at least the score that all but
``TRUSTED_LOSS`` of the trusted documents reach, so the verdict follows from the tables alone.

All work is in DataFrame functions; a text never leaves its row, and only counts per bucket are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, staged

BUCKETS = 1 << 14
#: Bits by which rows that may be trusted are told from those that are not, before their texts are shuffled.
BITMAP = 1 << 24
#: Cells of a score of 1, by which the place of the threshold is counted before scores are compared.
CELLS = 1024
TRUSTED_LOSS = 0.01
SMOOTHING = 1.0
GAPS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
RATIO = "array<double>"


def _removed(text: Column, characters: str) -> Column:
    """The text without these characters."""
    return F.translate(text, characters, "")


def _words(docs: DataFrame, text: str, *names: str) -> DataFrame:
    """``docs`` with the words' hashes as column names[1], by way of the words in names[0]."""
    words, hashes = names
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), GAP), lambda w: w != "")
    return docs.withColumn(words, split).withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))


def _grams(hashes: str) -> Column:
    """Buckets of the words and of the pairs."""
    h = F.col(hashes)
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(BUCKETS)).cast("int")
    )
    return F.when(F.size(h) > 1, F.concat(one, pairs)).otherwise(one)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and ``grams`` (array of buckets).

    word_chars: code points in words; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words
    in a window of three words that the text has twice or more. A null text has zero of all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: _removed(x, GAPS) != "")
    out = _words(docs, text, "words", "hashes").withColumn("lines", lines)
    n, h = F.size("hashes"), F.col("hashes")
    windows = F.transform(
        F.sequence(F.lit(2), n - 1), lambda i: F.struct(F.xxhash64(F.get(h, i - 2), F.get(h, i - 1), F.get(h, i)).alias("h"), i.alias("at"))
    )
    empty = F.array().cast("array<struct<h: bigint, at: int>>")
    out = out.withColumn("windows", F.sort_array(F.when(n > 2, windows).otherwise(empty)))
    w = F.col("windows")
    twice = F.filter(w, lambda x, i: (F.get(w, i + 1)["h"] == x["h"]) | (F.when(i > 0, F.get(w, i - 1)["h"]) == x["h"]))
    out = out.withColumn("repeats", F.sort_array(F.transform(twice, lambda x: x["at"])))
    r = F.col("repeats")
    fresh_words = F.transform(r, lambda at, i: F.coalesce(F.least(F.lit(3), F.get(r, i + 1) - at), F.lit(3)))
    counts = {
        "n_words": n,
        "word_chars": F.char_length(_removed(t, GAPS)),
        "n_symbols": F.char_length(t) - F.char_length(_removed(t, SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.aggregate(fresh_words, F.lit(0), lambda a, x: a + x),
    }
    counts = {k: v.cast("long").alias(k) for k, v in counts.items()}
    return out.select(*docs.columns, *counts.values(), _grams("hashes").alias("grams"))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, good): 1 for the rows whose id is in ``trusted``, null for the others.

    The bitmap of the ids has ``BITMAP`` bits, whatever the tables, so it can be broadcast; rows that it rules out are
    not shuffled, and the join decides about the others.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    spot = {"spot": F.call_function("bitmap_bucket_number", place), "bit": F.call_function("bitmap_bit_position", place)}
    maps = trusted.withColumns(spot).groupBy("spot").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    perhaps = F.col("doc_id").isNotNull() & F.coalesce(F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1, F.lit(False))
    rows = docs.select("doc_id", "text").withColumns(spot).join(F.broadcast(maps), "spot", "left").select("doc_id", "text", perhaps.alias("perhaps"))
    found = rows.filter("perhaps").join(trusted.withColumn("good", F.lit(1)), "doc_id", "left").select("text", "good")
    return found.union(rows.filter("not perhaps").select("text", F.lit(None).cast("int").alias("good")))


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): how often the corpus and the trusted documents have each bucket."""
    # The outer form, as the filter that the inner one brings along would work out the n-grams twice.
    grams = _words(_marked(docs, trusted), "text", "words", "hashes").select("good", F.explode_outer(_grams("hashes")).alias("bucket"))
    grams = grams.filter("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))


def score_quantile(rows: DataFrame, q: float) -> float | None:
    """The exact quantile of ``score`` as ``percentile`` has it, without all scores in one task; None without rows.

    Rows are counted by cells of the score, and only the scores of the cells around the quantile are compared.
    """
    rows = rows.select("score", F.floor(F.col("score") * CELLS).alias("cell"))
    counts = sorted((r.cell, r.n) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())
    if not counts:
        return None
    at = q * (sum(n for _, n in counts) - 1)
    ranks = math.floor(at), math.ceil(at)
    below, cells, before = 0, [], 0
    for cell, n in counts:
        if below <= ranks[1] and below + n > ranks[0]:
            before = before if cells else below
            cells.append(cell)
        below += n
    near = rows.filter(F.col("cell").between(cells[0], cells[-1])).groupBy("score").agg(F.count("*").alias("n")).collect()
    ends, total = [], before
    for r in sorted(near, key=lambda r: r.score):
        total += r.n
        ends.append((total, r.score))
    low, high = (next(x for end, x in ends if end > k) for k in ranks)
    return low if low == high else (ranks[1] - at) * low + (at - ranks[0]) * high


def log_ratios(counts: DataFrame) -> list[float]:
    """The log ratio of each bucket; the model is BUCKETS numbers, whatever the corpus."""
    found = {r.bucket: (r.target, r.raw) for r in counts.collect()}
    targets, raws = (sum(v[k] for v in found.values()) + SMOOTHING * BUCKETS for k in (0, 1))
    out = []
    for b in range(BUCKETS):
        target, raw = found.get(b, (0, 0))
        out.append(math.log((target + SMOOTHING) / targets) - math.log((raw + SMOOTHING) / raws))
    return out


def scored(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with the counts and ``score``, the mean log ratio of the n-grams (0 without words)."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast(RATIO)
    counted = with_counts(docs, text)
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    return counted.withColumn("score", F.coalesce(F.try_divide(total, F.size("grams")), F.lit(0.0))).drop("grams")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of each row of ``docs`` (doc_id, text).

    kept: not base_failed, and the score reaches the threshold. Without trusted documents in ``docs`` there is no
    threshold and the counts alone decide. Repeated ids are rows of their own; a null id is never trusted.
    """
    trusted = staged(trusted_ids(labels), "trusted")
    ratios = log_ratios(gram_counts(docs, trusted))
    out = staged(scored(docs.select("doc_id", "text"), ratios).drop("text"), "scores")
    threshold = score_quantile(out.join(trusted, "doc_id", "left_semi"), TRUSTED_LOSS)
    passed = F.lit(True) if threshold is None else F.col("score") >= threshold
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
