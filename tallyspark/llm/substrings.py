"""Removal of repeated passages, with difference-cover anchors.

A window is ``width`` consecutive words. Cover positions are those whose number modulo 13 is 0, 1, 3 or 9; for any two
positions some shift of at most 12 words moves both to cover positions. So two equal windows of 20 words share an
anchor, the 8 words at a cover position, at the same place inside both. A passage without a repeated anchor holds no
repeated window.

1. Each text is hashed at its cover positions only. An anchor that repeats within a batch is known to repeat; one of
   its kind and every other anchor is sent by its hash to find repeats across batches. What a hot passage sends is
   bounded by the number of batches.
2. Repeated anchors are extended to the windows that hold them. Windows are compared by 96 bits of hash, and the
   earliest place of each is found by a grouped minimum, again after each batch has kept its own earliest. Neighbouring
   windows mostly share their minimizer, the least hash of 8 words in them; they travel together under it.
3. Words covered by a window whose earliest place is elsewhere are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, mixed, staged

#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
WIDTH = 20
#: Bytes of text hashed at a time; a longer text is a slice of its own, hashed in pieces of this size.
SLICE = 1 << 20
LETTERS = mixed(np.arange(256), 11), mixed(np.arange(256), 12)
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
GAPS = np.zeros(256, bool)
GAPS[[32, 9, 10, 11, 12, 13]] = True
#: Anchor hashes only choose what is compared, so 48 bits do; 96 bits tell windows apart.
ANCHOR_BITS, CHECK_BITS = 48, 32
#: Stands for a null id, before all others.
NO_ID = -(2**63)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """The words of some texts: 64-bit hashes (two by default), the text they are in and their place there."""

    def __init__(self, column: list[bytes], hashes: int = 2):
        self.n = len(column)
        data = np.frombuffer(b" ".join(column) + b" ", np.uint8)
        edge = np.diff(GAPS[data].astype(np.int8), prepend=np.int8(1))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        firsts = np.cumsum([0] + [len(t) + 1 for t in column])[:-1]
        self.text = np.searchsorted(firsts, begin, side="right") - 1
        self.count = np.bincount(self.text, minlength=self.n)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.text)) - self.first[self.text]
        self.hash = np.empty((hashes, len(begin)), np.uint64)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + SLICE)))
            piece = data[begin[i] : end[j - 1]]
            for k in range(hashes):
                self.hash[k, i:j] = self._hashed(piece, begin[i:j] - begin[i], end[i:j] - begin[i], k)
            i = j

    @staticmethod
    def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        # Sums of letter x base^place, shifted back to the word's begin by the inverse powers of the odd base.
        size = -(-len(data) // SLICE) * SLICE
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(LETTERS[k][data] * _powers(BASES[k], size)[: len(data)], out=sums[1:])
            value = (sums[end] - sums[begin]) * _powers(pow(BASES[k], -1, 2**64), size)[begin]
        return mixed(value + (end - begin).astype(np.uint64), 20 + k)

    def runs(self, width: int, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``width`` words from each of the word numbers ``at`` on."""
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                out = out * np.uint64(BASES[k]) + self.hash[k][at + i]
        return mixed(out, 30 + k)


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about SLICE bytes, with the row the run begins at."""
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    held: list[bytes] = []
    size = begin = 0
    for i, value in enumerate(column):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= SLICE:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def _first_of_kind(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their key, and which have a key that repeats. Rows are in order of place."""
    order = np.lexsort(keys)
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    first, repeats = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order] = ~same
    same[:-1] |= same[1:]
    repeats[order] = same
    return first, repeats


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc, tie, text): the id, and a hash of the text where an id is null or repeats; a row's order is (doc, tie)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text", *more)
    # Usually empty; the planner broadcasts it only if its files are small.
    again = staged(rows.groupBy("doc").count().filter(f"count > 1 or doc = {NO_ID}").select("doc", F.lit(True).alias("again")), "again")
    tie = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("tie")
    return rows.join(again, "doc", "left").select("doc", tie, *rows.columns[1:])


def _anchors(rows: DataFrame, width: int) -> DataFrame:
    """(h, doc, tie, place): the anchors, ``place`` doubled and odd if the anchor is known to repeat."""
    size = width - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for begin, held in slices(batch.column(2)):
            w = Words(held)
            at = np.flatnonzero(cover[w.place % PERIOD] & (w.place + size <= w.count[w.text]) & (w.count[w.text] >= width))
            h = w.runs(size, 0, at) >> np.uint64(64 - ANCHOR_BITS)
            first, repeats = _first_of_kind(h)
            row = begin + w.text[at]
            # Rows that need no answer do not travel under the hot hash.
            away = mixed(doc[row] * 31 + w.place[at], 40) >> np.uint64(64 - ANCHOR_BITS) | np.uint64(1 << ANCHOR_BITS)
            yield {
                "h": np.where(first, h, away).astype(np.int64),
                "doc": doc[row],
                "tie": tie[row],
                "place": w.place[at] * 2 + repeats,
            }

    return by_batch(rows, work, "h long, doc long, tie long, place long")


def _windows(marked: DataFrame, width: int) -> DataFrame:
    """(m, doc, tie, place, end, hashes, checks): runs of windows to be compared, which start at ``place`` and share the
    minimizer m (end is 0), and stretches of words that are covered by windows that are no slice's earliest (up to end)."""
    size = width - PERIOD + 1
    spread = width - size

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, tie, anchors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for begin, held in slices(batch.column(2)):
            ties, docs = tie[begin : begin + len(held)], doc[begin : begin + len(held)]
            order = np.lexsort((ties, docs))
            once = np.ones(len(order), bool)  # equal rows count as one document
            once[1:] = (np.diff(docs[order]) != 0) | (np.diff(ties[order]) != 0)
            order = order[once]
            w = Words([held[i] for i in order])
            here = np.zeros(len(w.text) + 1, np.int32)
            for i, k in enumerate(order):
                starts = anchors[int(begin + k)].values.to_numpy()
                # Windows that hold the anchor; several anchors may open or close at one word.
                np.add.at(here, w.first[i] + np.maximum(starts - spread, 0), 1)
                np.add.at(here, w.first[i] + starts + 1, -1)
            at = np.flatnonzero((np.cumsum(here)[:-1] > 0) & (w.place + width <= w.count[w.text]))
            if not len(at):
                continue
            h, check = w.runs(width, 0, at), w.runs(width, 1, at) >> np.uint64(64 - CHECK_BITS)
            first, _ = _first_of_kind(check, h)
            row = begin + order[w.text[at]]
            short = np.zeros(len(w.text), np.uint64)
            inner = np.unique((at[:, None] + np.arange(spread + 1)).ravel())
            short[inner] = w.runs(size, 0, inner)
            least = short[at]
            for i in range(1, spread + 1):
                least = np.minimum(least, short[at + i])
            least >>= np.uint64(64 - ANCHOR_BITS)
            ask, rest = np.flatnonzero(first), np.flatnonzero(~first)

            def heads(of: np.ndarray, *same: np.ndarray) -> np.ndarray:
                cut = np.ones(len(of), bool)
                cut[1:] = np.diff(at[of]) != 1
                for x in (row, *same):
                    cut[1:] |= x[of][1:] != x[of][:-1]
                return np.flatnonzero(cut)

            runs, gaps = heads(ask, least), heads(rest)
            lengths = np.diff(np.append(gaps, len(rest)))
            lead = np.concatenate([ask[runs], rest[gaps]])
            # Stretches need no answer: they travel under a key of their own, as a run of one window without hash.
            alone = mixed(doc[row[rest[gaps]]], 41) >> np.uint64(64 - ANCHOR_BITS)
            offsets = np.concatenate([runs, len(ask) + np.arange(len(gaps) + 1)]).astype(np.int32)
            filler = np.zeros(len(gaps), np.int64)
            yield {
                "m": np.concatenate([least[ask[runs]], alone]).astype(np.int64),
                "doc": doc[row[lead]],
                "tie": tie[row[lead]],
                "place": w.place[at[lead]].astype(np.int32),
                "end": np.concatenate([np.zeros(len(runs), np.int64), w.place[at[rest[gaps]]] + lengths - 1 + width]).astype(np.int32),
                "hashes": pa.ListArray.from_arrays(offsets, np.concatenate([h[ask].view(np.int64), filler])),
                "checks": pa.ListArray.from_arrays(offsets, np.concatenate([check[ask].astype(np.uint32).view(np.int32), filler.astype(np.int32)])),
            }

    schema = "m long, doc long, tie long, place int, end int, hashes array<bigint>, checks array<int>"
    return by_batch(marked, work, schema)


def _stretches(rows: DataFrame, width: int) -> DataFrame:
    """(doc, tie, cuts): for each text with repeats, the stretches of words to be removed (begin and end in one number)."""
    anchors = _anchors(rows, width)
    kinds = F.count("*").over(Window.partitionBy("h"))
    found = anchors.withColumn("n", kinds).filter("n > 1 or place % 2 = 1")
    places = found.groupBy("doc", "tie").agg(F.collect_set(F.expr("cast(place div 2 as int)")).alias("anchors"))
    runs = _windows(rows.join(places, ["doc", "tie"]), width).repartition("m")
    windows = runs.select("m", "doc", "tie", "place", "end", "checks", F.posexplode_outer("hashes").alias("nth", "h"))
    windows = windows.select("m", "doc", "tie", (F.col("place") + F.col("nth")).alias("place"), "end", "h", F.get("checks", F.col("nth")).alias("check"))
    # Equal windows have equal minimizers, so they are in one partition already.
    earliest = F.min(F.struct("doc", "tie", "place")).over(Window.partitionBy("m", "h", "check"))
    later = windows.withColumn("earliest", earliest).filter("end > 0 or earliest != struct(doc, tie, place)")
    end = F.when(F.col("end") > 0, F.col("end")).otherwise(F.col("place") + width).cast("long")
    return later.groupBy("doc", "tie").agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(end)).alias("cuts"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text (the words that stay, joined by a blank), n_words (before) and n_removed of each row of ``docs``.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a smaller doc_id, or in the same
    document before. Windows are judged on the input. Rows without an id come before all others; rows that share an
    id (or have none) are ordered by a hash of their texts, and equal ones among them count as one document. A null
    text has no words and gives an empty one. An empty table gives no rows.
    """
    if width < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words need another cover")
    marked = keyed(docs)
    rows = marked.join(_stretches(marked, width), ["doc", "tie"], "left")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, counts, gone = [], [], []
        column = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
        for value, cuts in zip(column, batch.column(2)):
            words = (value.as_py() or b"").split()
            counts.append(len(words))
            if cuts.is_valid:
                pairs = cuts.values.to_numpy()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, pairs >> 32, 1)
                np.add.at(step, pairs & 0xFFFFFFFF, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
            gone.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode())
        yield {"doc": batch.column(0), "text": texts, "n_words": counts, "n_removed": gone}

    out = by_batch(rows.select("doc", "text", "cuts"), work, "doc long, text string, n_words long, n_removed long")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "text", "n_words", "n_removed")


def repeats_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the text that stays, with windows of 20 words."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
