"""Ranked lexical search with range-maximum tables over posting lists.

Scores are sums over an item's terms of weight x saturated frequency (a BM25 in whole numbers). Terms are matches of
``[0-9A-Za-z and all beyond ASCII]+`` with A-Z lower-cased.

1. Each text is cut into terms once. What stays is its length and how often each term of the items occurs in it.
2. Document counts are added up over all documents; weights follow.
3. A task indexes its documents ``SHARD`` at a time, numbered by their length: one posting list per term, with the
   impact of each posting (its part of the score) and a sparse table of the places of range maxima over the lists.
4. An item's search keeps intervals of documents. The sum of the range maxima of its terms bounds the scores in an
   interval. The intervals with the largest bounds are taken first: each is split at the document with the
   interval's largest impact, which is scored, and the parts to both sides get bounds of their own. It ends when no
   bound reaches the k-th best score so far, which the task carries from shard to shard.

Documents never meet in one place; each task hands on k rows an item at most. Items are taken in blocks of ``BLOCK``
bytes of text, so that the terms that tasks must know stay bounded.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, staged, texts

#: Letters and digits, A-Z as a-z, and bytes beyond ASCII stay; other characters become blanks.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of text that are cut into terms at a time.
SLICE = 1 << 22
#: Documents and postings of an index, and intervals that are split at a time.
SHARD, POSTINGS, STEP = 1 << 15, 1 << 22, 128
#: Bytes of items' texts that are searched for at a time.
BLOCK = 1 << 24


def term_counts(text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs."""
    data, counts, n, begin = text.translate(TERMS), Counter(), 0, 0
    while begin < len(data):
        end = data.find(b" ", begin + SLICE) if len(data) - begin > SLICE else -1
        words = data[begin : end if end >= 0 else len(data)].split()
        counts.update(words)
        n += len(words)
        begin = end if end >= 0 else len(data)
    return n, counts


def hits(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the length of each document, and the numbers of its terms that are in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        lengths, terms, counts, ends = [], [], [], [0]
        number = known.value
        keys = number.keys()
        for text in texts(batch.column(1)):
            n, found = term_counts(text)
            lengths.append(n)
            for t in found.keys() & keys:
                terms.append(number[t])
                counts.append(found[t])
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
        yield {"doc_id": batch.column(0), "n": lengths, "terms": lists[0], "counts": lists[1]}

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n long, terms array<int>, counts array<bigint>")


class Index:
    """Posting lists of some documents, one behind the other, with a sparse table of range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        keys = term.astype(np.int64) * n_docs + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.doc, self.impact = keys[order], doc[order], impact[order]
        self.first = np.searchsorted(self.keys, np.arange(n_terms + 1) * n_docs)
        longest = int(np.diff(self.first).max(initial=1))
        # Row j has the place of the maximum of the 2^j postings from each place on; queries never leave a list.
        self.table = np.empty((longest.bit_length(), len(keys)), np.int32)
        self.table[0] = np.arange(len(keys))
        for j in range(1, len(self.table)):
            half, old = 1 << (j - 1), self.table[j - 1]
            self.table[j] = old
            a, b = old[: max(0, len(keys) - half)], old[half:]
            self.table[j, : len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
        self.level = np.zeros(longest + 1, np.int64)
        for size in range(2, longest + 1):
            self.level[size] = self.level[size >> 1] + 1

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest impact among the postings lo to hi - 1 (hi > lo)."""
        level = self.level[hi - lo]
        a, b = self.table[level, lo], self.table[level, hi - (1 << level)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best, ids: list) -> None:
        """Offer the documents that may be among the best for an item's terms (each counted so many times)."""
        if not len(terms):
            return
        lo, hi = self.first[terms][None, :], self.first[terms + 1][None, :]
        heap: list[tuple] = []
        serial = 0

        def push(lo: np.ndarray, hi: np.ndarray) -> None:
            nonlocal serial
            some, where = np.nonzero(hi > lo)
            if not len(some):
                return
            place = self.largest(lo[some, where], hi[some, where])
            value = np.zeros(lo.shape, np.int64)
            value[some, where] = self.impact[place] * times[where]
            doc = np.zeros(lo.shape, np.int64)
            doc[some, where] = self.doc[place]
            bound = value.sum(axis=1)
            pivot = doc[np.arange(len(doc)), value.argmax(axis=1)]
            for i in np.flatnonzero(bound >= max(1, best.least())).tolist():
                serial += 1
                heapq.heappush(heap, (-int(bound[i]), serial, int(pivot[i]), lo[i], hi[i]))

        push(lo, hi)
        step = 1
        while heap:
            taken = []
            while heap and len(taken) < step and -heap[0][0] >= best.least():
                taken.append(heapq.heappop(heap))
            if not taken:
                return
            pivot = np.array([x[2] for x in taken])
            lo, hi = np.array([x[3] for x in taken]), np.array([x[4] for x in taken])
            middle = np.clip(np.searchsorted(self.keys, terms * self.n_docs + pivot[:, None]), lo, hi)
            has = middle < hi
            has &= self.doc[np.where(has, middle, 0)] == pivot[:, None]
            scores = (np.where(has, self.impact[np.where(has, middle, 0)], 0) * times).sum(axis=1)
            best.offer(scores.tolist(), [ids[p] for p in pivot.tolist()])
            push(np.concatenate([lo, middle + has]), np.concatenate([middle, hi]))
            step = min(STEP, step * 2)


class Best:
    """The k best documents: larger scores first, then smaller ids (null before all)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score that a further document needs at least (a tie may win by its id)."""
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def offer(self, scores: list[int], ids: list) -> None:
        least = self.least()
        new = [(s, i) for s, i in zip(scores, ids) if s >= least and s > 0]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[: self.k]


def found(hits: DataFrame, weights: np.ndarray, items: list[tuple], total: tuple[int, int], k: int, shard: int = SHARD) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item.

    ``items`` are (number, term numbers, times); ``total`` is the number of documents and of their terms.
    """
    known = hits.sparkSession.sparkContext.broadcast((weights, items))
    n_docs, n_terms = total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = known.value
        best = {number: Best(k) for number, _, _ in wanted}

        def index(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows).combine_chunks()
            n = table.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            number = np.empty(len(n), np.int64)
            number[order] = np.arange(len(n))
            ids = table.column("doc_id").take(pa.array(order)).to_pylist()
            lists = table.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            term, count = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), sizes)
            m = 75 + (25 * n * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m[owner]))
            some = impact > 0
            made = Index(number[owner[some]], term[some], impact[some], len(n), len(weight))
            for item, terms, times in wanted:
                made.search(terms, times, best[item], ids)

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 10):
                some = batch.slice(begin, 1 << 10)
                held.append(some)
                rows, size = rows + some.num_rows, size + len(some.column(2).flatten())
                if rows >= shard or size >= POSTINGS:
                    index(held)
                    held, rows, size = [], 0, 0
        if held:
            index(held)
        out = [(number, doc, score) for number, b in best.items() for score, doc in b.rows]
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return hits.filter("n > 0").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    A term of df of the N documents that have a term weighs floor(1000 ln((2N + 2) / (2 df + 1))); tf occurrences in a
    document of n terms count (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L and L terms in all documents.
    Equal scores are in the order of doc_id, null first. Rows that share an id are documents of their own; rows of
    ``items`` that share an item_id (or have none) are one item with all their terms. A null or empty text has no term:
    such a document is never found, and such an item has no row. Empty tables give no rows.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    out: DataFrame | None = None
    for b in range(blocks):
        # The rows of a block: a bounded part of the query set.
        mine: dict[int | None, Counter] = {}
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        for r in part.toLocalIterator():
            mine.setdefault(r.item_id, Counter()).update(term_counts(r.text.encode())[1])
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in mine.values() for t in c}))}
        seen = staged(hits(docs, vocabulary), "hits")
        n_docs, n_terms = seen.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not vocabulary or not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in seen.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        ids = list(mine)
        wanted = []
        for i, item in enumerate(ids):
            terms = np.array(sorted(vocabulary[t] for t in mine[item]), np.int64)
            names = {vocabulary[t]: n for t, n in mine[item].items()}
            terms = terms[weights[terms] > 0]
            wanted.append((i, terms, np.array([names[t] for t in terms.tolist()], np.int64)))
        best = found(seen, weights, wanted, (n_docs, n_terms), k, shard)
        number = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
        best = best.join(F.broadcast(number), "item").select("item_id", "doc_id", "score")
        out = best if out is None else out.union(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 20 best documents of each item; see ``search``."""
    return search(docs, items)
