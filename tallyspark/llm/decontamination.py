"""Benchmark decontamination with SimHash windows.

1. A text can only resemble an item if they share a shingle (five words in a row), so shared shingles say where windows
   must lie: a window has as many words as the item and begins where the item would if the shared shingle is at the
   same place in both.
2. Each window has a SimHash of 64 bits over its shingles. Fingerprints are cut into 4 blocks of 16 bits; fingerprints
   that differ in at most 15 bits agree in one block up to 3 bits, so items are filed under every value within 3 bits
   of each of their blocks, and a window finds all items within the radius by its own 4 blocks.
3. Similar pairs beyond the radius are found by prefixes: a window that is like an item has one of the item's first
   m - ceil(0.8 m) + 1 of m shingles, in any fixed order. They are ordered by how many places of the benchmark have them,
   so a passage that many items share brings only those together that consist of little else.
4. Window and item are compared exactly: the shingles' weights are how often each has them, and the similarity is the
   sum of the smaller weights over the sum of the larger ones.

All of it is DataFrame functions. Words are lower-cased runs of letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, staged

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_DISTANCE = 4, 16, 3
#: All fingerprints within so many bits are found.
RADIUS = BLOCKS * (BLOCK_DISTANCE + 1) - 1
#: Shingles of items up to which they are broadcast (16 bytes each); more are met by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def _shingled(rows: DataFrame, text: str, words: str, shingles: str) -> DataFrame:
    """``rows`` with the word hashes and the shingle hashes (none if there are fewer than five words)."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    split = F.transform(F.split(F.trim(plain), " "), lambda w: F.xxhash64(w))
    rows = rows.withColumn(words, split)
    h = F.col(words)
    made = F.transform(
        F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])
    )
    return rows.withColumn(shingles, F.when(F.size(h) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>")))


def _simhash(shingles: str) -> Column:
    """64 bits; a bit is set if it is in over half the hashes."""
    h = F.col(shingles)

    def bit(k: Column) -> Column:
        ones = F.aggregate(h, F.lit(0), lambda n, x: n + F.getbit(x, k).cast("int"))
        return F.when(2 * ones > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(bit(k)))


def _block(fp: str, k: Column) -> Column:
    return F.call_function("shiftright", F.col(fp), k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _within(items: DataFrame) -> DataFrame:
    """(item, fp, block, value): each item under all values within BLOCK_DISTANCE bits of each of its blocks."""
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(BLOCK_BITS)])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    rows = items.select("item", "fp", blocks.alias("block")).withColumn("value", _block("fp", F.col("block"))).withColumn("last", F.lit(-1))
    out = [rows]
    for _ in range(BLOCK_DISTANCE):
        # Flip one more bit, in ascending order of bits, so that each value comes once.
        rows = rows.select("item", "fp", "block", "value", "last", F.posexplode(bits).alias("bit", "mask")).filter("bit > last")
        rows = rows.select("item", "fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col("bit").alias("last"))
        out.append(rows)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.drop("last")


def _prefixes(items: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """(item, h, m): of each item's ``m`` shingles the rarest, one of which any text of the similarity has."""
    common = places.groupBy("h").agg(F.count("*").alias("c"))
    rows = items.select("item", F.size("shingles").alias("m"), F.explode("shingles").alias("h")).join(common, "h")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("c", "h"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * similarity - 1e-9) + 1).select("item", "h", "m").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): documents that hold a window like an item, with the best window.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Items of fewer than five words are too short to tell
    a leak from chance and match nothing; the same goes for texts. Of equal windows the first counts. Rows without an
    id are left out, as no result can name them; rows that share an id are taken as parts of one document, and
    texts that share an item_id as versions of one item. Items with equal texts are all reported. Empty tables give no rows.
    """
    alike = _alike(docs.filter("doc_id is not null").select("doc_id", "text"), benchmark, similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("best")
    return alike.groupBy("doc_id", "item.item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), F.col("best.n").alias("n_words")
    )


def _alike(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, row, start, n, item, similarity): all windows like an item; ``row`` is a hash of the text."""
    version = F.struct("item_id", F.xxhash64("text").alias("version")).alias("item")
    items = benchmark.filter("item_id is not null").select(version, "text").dropDuplicates(["item"])
    items = _shingled(items, "text", "words", "shingles").withColumn("fp", _simhash("shingles"))
    items = staged(items.select("item", F.size("words").alias("n"), "shingles", "fp"), "items").filter(F.size("shingles") > 0)
    # Where an item's shingles lie; items of one length share windows.
    places = staged(items.select("n", F.posexplode("shingles").alias("at", "h")).distinct(), "places")
    few = places.count() <= BROADCAST_SHINGLES

    hashed = _shingled(docs, "text", "words", "shingles")
    hashed = hashed.select("doc_id", F.xxhash64("text").alias("row"), F.size("words").alias("size"), "shingles")
    window = F.slice("shingles", F.col("start") + 1, F.col("n") - (SHINGLE - 1)).alias("shingles")
    start = F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start")
    end = F.least(F.greatest(F.col("pos") - F.col("at"), F.lit(0)) + F.col("n"), F.col("size"))
    # The outer form, as the filter that the inner one brings along would work out the shingles twice. Where the items
    # fit, windows are cut as the shingles are met; else texts with windows are found first and read again.
    kept = ["shingles"] if few else []
    spots = hashed.select("doc_id", "row", "size", *kept, F.posexplode_outer("shingles").alias("pos", "h")).filter("h is not null")
    met = spots.join(F.broadcast(places) if few else places, "h").select("doc_id", "row", "size", start, end.alias("end"), *kept)
    met = met.withColumn("n", F.col("end") - F.col("start")).filter(f"n >= {SHINGLE}")
    if few:
        cut = met.select("doc_id", "row", "size", "start", "n", window)
    else:
        held = met.select("doc_id", "row", "start", "n").distinct().groupBy("doc_id", "row")
        held = staged(held.agg(F.collect_list(F.struct("start", "n")).alias("windows")), "windows")
        cut = hashed.join(held, ["doc_id", "row"]).select("doc_id", "row", "size", "shingles", F.explode("windows").alias("w"))
        cut = cut.select("doc_id", "row", "size", "w.start", "w.n", "shingles").select("doc_id", "row", "size", "start", "n", window)
    marked = staged(cut.dropDuplicates(["doc_id", "row", "start", "n"]).withColumn("fp", _simhash("shingles")), "marked")

    blocks = marked.select("doc_id", "row", "size", "start", "n", "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    blocks = blocks.withColumn("value", _block("fp", F.col("block")))
    filed = _within(items.select("item", "fp")).withColumnRenamed("fp", "item_fp")
    pairs = blocks.join(filed, ["block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    key = ["doc_id", "row", "start", "n", "item"]

    rare = staged(_prefixes(items, places, similarity), "prefixes")
    rare = F.broadcast(rare) if rare.count() <= BROADCAST_SHINGLES else rare
    met = marked.select(*key[:4], "size", F.explode(F.array_distinct("shingles")).alias("h")).join(rare, "h")
    # A window has at most as many shingles as an item of its size, and similar ones have about as many.
    long_enough = F.col("n") - (SHINGLE - 1) >= F.col("m") * similarity - 1e-9
    pairs = pairs.select(*key, "size").union(met.filter(long_enough).select(*key, "size")).distinct()
    # Windows of other items' sizes are not this item's, unless the text ends there.
    sizes = items.select(F.col("item").alias("of"), F.col("n").alias("item_n"))
    pairs = pairs.join(sizes, F.col("item") == F.col("of"))
    pairs = staged(pairs.filter(F.col("n") == F.least("item_n", F.col("size") - F.col("start"))).select(*key), "pairs")

    mine = pairs.join(marked.select("doc_id", "row", "start", "n", "shingles"), key[:4]).select(*key, F.explode("shingles").alias("h"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    theirs = pairs.join(items.select("item", "shingles"), "item").select(*key, F.explode("shingles").alias("h"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    weights = mine.union(theirs).groupBy(*key, "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    likeness = (F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")
    return weights.groupBy(*key).agg(likeness).filter(F.col("similarity") >= similarity)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark.

    Every row is judged by its own text, also where ids repeat or are null. Empty tables: no rows, or all rows.
    """
    no_id = F.lit(-(1 << 63))
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), "text")
    id_, text = fresh(docs.columns, "leaked"), fresh(docs.columns, "leaked_text")
    bad = _alike(held, benchmark, similarity).select(F.col("doc_id").alias(id_), F.col("row").alias(text)).distinct()
    same = (F.coalesce(docs["doc_id"].cast("long"), no_id) == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(text))
    return docs.join(bad, same, "left_anti")
