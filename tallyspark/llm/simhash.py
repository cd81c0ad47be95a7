"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprints are collapsed to distinct ones first, so exact copies cost one row however many there are. A fingerprint
is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in two bits or fewer agree in at least one
segment, and the segment after it then differs in two bits or fewer, so its Golay keys have one in common: each
fingerprint is filed under (segment as it is, key of the next segment), about 16 keys in all, and only fingerprints
that share a key are compared.

A key under which more than ``BUCKET`` fingerprints lie is not compared pair by pair. Its members are filed under each
of the 65 words within one bit of them: two members share such a word exactly if they differ in two bits or fewer.
Members that share a word are tied to the smallest of them, which gives the same components with no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import by_batch, fresh, staged, texts
from .components import components

#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET = 64
#: Bits in which linked fingerprints may differ; the keys are made for two.
DISTANCE = 2
SEED = 42
ROWS = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits; a bit is set if it is in over half the shingle hashes. A text without words has 0."""
    found = text.lower().split()  # bytes: only A to Z are lowered
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in zip(*(found[k:] for k in range(words)))], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), ROWS):
        bits = np.unpackbits(hashes[k : k + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    return _fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words)


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """The columns of ``rows`` (longs, the text last) with fp in place of the text."""
    names = rows.columns[:-1]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        fps = np.array([fingerprint(t, words) for t in texts(batch.column(len(names)))], np.uint64)
        yield {n: batch.column(i) for i, n in enumerate(names)} | {"fp": fps.view(np.int64)}

    return by_batch(rows, work, ", ".join(f"{n} long" for n in [*names, "fp"]))


def _filed(fps: DataFrame) -> DataFrame:
    """(fp, key): each fingerprint under its keys."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        fp = batch.column(0).to_numpy().view(np.uint64)
        parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        for k, exact in enumerate(parts):
            fuzzy = golay.keys(parts[(k + 1) % 3])
            row, col = np.nonzero(fuzzy >= 0)
            yield {"fp": fp.view(np.int64)[row], "key": (k << 34) | (exact[row] << 12) | fuzzy[row, col]}

    return by_batch(fps.select("fp"), work, "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that differ in two bits or fewer.

    Every component of the true links is connected by these edges, and every edge is a true link; members of a crowded
    key are tied in stars instead of pairs.
    """
    filed = _filed(fps)
    crowd = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(filed.join(crowd, "key"), "shared")
    few = shared.filter(F.col("n") <= BUCKET).select("fp", "key")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))

    many = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    around = F.explode(F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)) for k in range(64)]))
    balls = many.select("fp", around.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    hubs = balls.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = balls.join(hubs, "word").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.select("a", "b").union(stars)


def _rooted(nodes: DataFrame) -> DataFrame:
    """fp, least, root: a name of the component of each distinct fingerprint."""
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of each row of ``docs`` (doc_id, text).

    A null text or one without words has fingerprint zero and links like any other. Rows with equal ids stay separate
    rows; null ids take part in links, but not as a component's id (null where all are null). An empty table gives no rows.
    """
    marked = staged(fingerprints(docs, words), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    placed = _rooted(nodes)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, with 3-word shingles and 2 bits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each group of near-duplicates: the first by doc_id, rows without an id last.

    Every row is judged by its own text, also where ids repeat or are null: rows of one id are told apart by a hash of
    their texts, and of rows equal in both one stays, the least by its columns. An empty table gives no rows.
    """
    key, tie, kept = (fresh(docs.columns, n) for n in ("key", "tie", "kept"))
    no_id = F.lit((1 << 63) - 1)  # after all ids
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), no_id), tie: F.xxhash64("text")})
    marked = keyed.select(F.col(key).alias("doc_id"), F.col(tie).alias("tie"), "text")
    marked = staged(_fingerprints(marked, words), "marked")
    nodes = staged(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "tie")).alias("least")), "nodes")
    firsts = _rooted(nodes).groupBy("root").agg(F.min("least").alias("least"))
    firsts = firsts.select(F.col("least.doc_id").alias(key), F.col("least.tie").alias(tie))
    ranked = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    # Joined and grouped by the same two columns, so whole rows are shuffled once.
    first = keyed.join(firsts, [key, tie], "left_semi").groupBy(key, tie).agg(F.min_by(F.struct(*docs.columns), F.struct(*ranked)).alias(kept))
    return first.select(f"{kept}.*")
