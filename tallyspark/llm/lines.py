"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. A line goes if an earlier line (of a smaller doc_id, or before it in the same
document) has a Jaccard similarity of ``SIMILARITY`` or more with it.

1. Words are counted in a table of fixed size (``BUCKETS``); a word's rarity is the count of its bucket. Any fixed order
   of words gives exact results, so sharing a bucket costs speed only.
2. Each line lists its words from rare to common. Similar lines share a word in their prefixes, the first
   n - ceil(0.8 n) + 1 words; words that occur once in the corpus are left out. Lines that share a prefix word are
   sorted by length in the shuffle, so that each meets only those that are long enough, and compared by the positions of
   the word and by 128 parity bits of their words, none of which drops a similar pair. Of two similar sets the smaller has
   the word even in its first n - ceil(8 n / 9) + 1 words, so only words that are there for some line bring lines
   together. Sets of up to 3 words are similar only if they are equal; they have no prefix.
3. What is left is verified on the words themselves. A set needs one earlier set that is similar, so a task sends on the
   ``NEAREST`` closest (by the parity bits) of the earlier sets that each set is left with, and whether there are others:
   what is sent grows with the sets, not with their pairs. The closest one is verified first, and the next ones of sets
   that it does not settle. Only sets with still others bring their prefix words once more, to meet all of them, by 128
   more bits.

Lines with equal sets are one set; a set goes by the place (doc, tie, line) of its earliest line. In a group of more than
``GROUP`` sets with one prefix word (counting those that have it so early) each is first compared with the group's
earliest sets only; sets that are not settled then are compared with the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, by_batch, discard, mixed, staged
from .substrings import NO_ID, Words, keyed, slices

SIMILARITY = 0.8
#: Smaller sets are similar to equal ones only (a set of 4 words still is to one of 5).
LEAST_WORDS = 4
BUCKETS = 1 << 22
#: Tables that are added up at a time, and the largest count.
FAN_IN, MOST = 8, 2**16 - 1
#: Sets with a prefix word up to which all are compared, and earliest sets that the members of larger groups meet first.
GROUP, HUBS = 1024, 8
#: Closest earlier sets that a task sends for each set.
NEAREST = 8
#: Prefix words that a task compares at a time, and pairs at a time.
ROWS, PAIRS = 1 << 17, 1 << 17
#: Occurrences of a word (by the table) from which its group is not brought together in one task, unless as few sets have
#: it in their prefixes.
HOT = 1 << 14
#: Bits by which lines are chosen before they are shuffled (16 MB at most; as many for each place, if there is room).
LINE_BITS, BITS_EACH = 1 << 27, 64
#: Classes of words by which prefix words are chosen for the sets that are left (a broadcast of as many rows at most).
CLASSES = 1 << 20

PLACE = ["doc", "tie", "line"]
MEMBER = ["id", "parity", "more", "size", "at"]
#: A set, a close earlier set that it may resemble (null: none is known), by how many of FAR parts of their words they
#: are known to differ, and whether there may be others than the rows of the set name.
FOUND = "doc long, tie long, line int, far int, a_doc long, a_tie long, a_line int, others boolean"
FAR = 4096


def _flat(held: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All lines of some texts, lower-cased, with the text and the number of each."""
    column = [t.lower().split(b"\n") for t in held]
    counts = np.array([len(x) for x in column])
    owner = np.repeat(np.arange(len(held)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return [x for lines in column for x in lines], owner, number


def rarity(rows: DataFrame) -> np.ndarray:
    """For each bucket, 12 times the binary logarithm of its words' occurrences (0: one or none; counts end at MOST).

    Each task counts into a table of its own, which travels compressed, as most of it is empty; tables are added up by
    tasks, FAN_IN at a time, until one is left.
    """

    def packed(table: np.ndarray) -> bytes:
        return pa.compress(np.minimum(table, MOST).astype(np.uint16), codec="zstd", asbytes=True)

    def unpacked(counts: bytes | pa.Buffer) -> np.ndarray:
        return np.frombuffer(pa.decompress(counts, 2 * BUCKETS, codec="zstd"), np.uint16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, held in slices(batch.column(0)):
                h = Words([t.lower() for t in held], 1).hash[0]
                np.add.at(table, (h >> np.uint64(42)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([packed(table)])], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.uint32)
        for x in group.column("counts"):
            total += unpacked(x.as_buffer())
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([packed(total)])})

    schema = "part int, counts binary"
    tables = staged(rows.select("text").mapInArrow(count, schema), "rarity")
    while tables.count() > 1:
        # As many partitions as groups, so that no task has many tables.
        groups = tables.groupBy(F.expr(f"part div {FAN_IN}").alias("group"))
        before, tables = tables, staged(groups.applyInArrow(add, schema), "rarity")
        discard(before)
    found = tables.first()
    discard(tables)
    counts = unpacked(bytes(found.counts)) if found else np.zeros(BUCKETS, np.uint16)
    return np.round(12 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


class Sets:
    """The word sets of some lines, with the words of each from rare to common."""

    def __init__(self, column: list[bytes], rare: np.ndarray):
        w = Words(column, 1)
        h = w.hash[0]
        rank = rare[(h >> np.uint64(42)).astype(np.int64)]
        low = rank.astype(np.uint64) << np.uint64(36) | h >> np.uint64(28)
        if w.n < 1 << 20:
            order = np.argsort(w.text.astype(np.uint64) << np.uint64(44) | low)
        else:
            order = np.lexsort((low, w.text))
        line, h, rank = w.text[order], h[order], rank[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.line, self.h, self.rank = line[once], h[once], rank[once]
        self.size = np.bincount(self.line, minlength=w.n)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.h)) - self.first[self.line]

    def sums(self, key: int) -> np.ndarray:
        """A hash of each line's set."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.h, key))])
        return mixed(total[self.first + self.size] - total[self.first], key)

    def parity(self, half: int = 0) -> np.ndarray:
        """64 of 256 bits, in two tables of 128; each is the parity of the line's words that fall on it there."""
        at = mixed(self.h, 53 + half // 2)
        one = ((at >> np.uint64(6) & np.uint64(1)) == half % 2).astype(np.uint64) << (at & np.uint64(63))
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(one)])
        return total[self.first + self.size] ^ total[self.first]


def _lines(rows: DataFrame, rare) -> DataFrame:
    """(doc, tie, line, id, check, size, parity, more, third, fourth, lead, cold, keys): every line with a word; ``keys`` (32 bits of the
    prefix words from place ``lead`` on, the first ``cold`` of them not hot) only for sets of LEAST_WORDS or more, and
    the earliest line with a set in a slice."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for begin, held in slices(batch.column(2)):
            column, owner, number = _flat(held)
            s = Sets(column, rare.value)
            judged = np.flatnonzero(s.size)
            id_, check = s.sums(51), s.sums(52)
            row = begin + owner[judged]
            # Of equal sets, the earliest line.
            place = judged[np.lexsort((number[judged], tie[row], doc[row]))]
            one = np.zeros(len(column), bool)
            one[place[np.unique(id_[place], return_index=True)[1]]] = True
            prefix = np.where(s.size < LEAST_WORDS, 0, s.size - (4 * s.size + 4) // 5 + 1)
            # Words are in order of rank, so those that are left out come first and hot ones last.
            within = one[s.line] & (s.place < prefix[s.line])
            lead = np.bincount(s.line[within & (s.rank == 0)], minlength=len(column))
            use = np.flatnonzero(within & (s.rank > 0))
            cold = np.bincount(s.line[use[s.rank[use] < 12 * np.log2(HOT)]], minlength=len(column))
            ends = np.cumsum(np.bincount(s.line[use], minlength=len(column))[judged])
            yield {
                "doc": doc[row],
                "tie": tie[row],
                "line": number[judged].astype(np.int32),
                "id": id_[judged].view(np.int64),
                "check": (check[judged] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                "size": s.size[judged].astype(np.int32),
                "parity": s.parity(0)[judged].view(np.int64),
                "more": s.parity(1)[judged].view(np.int64),
                "third": s.parity(2)[judged].view(np.int64),
                "fourth": s.parity(3)[judged].view(np.int64),
                "lead": lead[judged].astype(np.int32),
                "cold": cold[judged].astype(np.int32),
                "keys": pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), (s.h[use] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            }

    return by_batch(rows, work, "doc long, tie long, line int, id long, check int, size int, parity long, more long, third long, fourth long, lead int, cold int, keys array<int>")


def _early(at, size):
    """Whether a word is in the shorter prefix that suffices for the smaller of two similar sets, its first
    n - ceil(8 n / 9) + 1 words. The one rule for columns and for numpy arrays."""
    ninths = size * 8 + 8
    return at < size - (F.floor(ninths / 9) if isinstance(size, Column) else ninths // 9) + 1


def _passes(a: str, b: str) -> Column:
    """The filters on two members of a group, as columns ``a`` and ``b``: length, position and parity."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    both = x + y
    # Similar sets have at least ceil(4/9 (x + y)) words in common and at most floor((x + y) / 9) that are not.
    least = F.expr(f"({a}.size + {b}.size) * 4 div 9") + F.when(both * 4 % 9 > 0, 1).otherwise(0)
    ahead = F.least(x - F.col(f"{a}.at"), y - F.col(f"{b}.at"))
    return (F.least(x, y) * 5 >= F.greatest(x, y) * 4) & (ahead >= least - F.least(F.col(f"{a}.at"), F.col(f"{b}.at"))) & (_apart(a, b) * 9 <= both)


def _apart(a: str, b: str, bits: tuple[str, str] = ("parity", "more")) -> Column:
    return sum(F.bit_count(F.col(f"{a}.{half}").bitwiseXOR(F.col(f"{b}.{half}"))) for half in bits)


def _passes_all(a: str, b: str) -> Column:
    """The filters of ``_passes``, that the word is early in the smaller set, and 128 other parity bits."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    early = F.when(x <= y, _early(F.col(f"{a}.at"), x)).otherwise(_early(F.col(f"{b}.at"), y))
    return early & _passes(a, b) & (_apart(a, b, ("third", "fourth")) * 9 <= x + y)


def _compared(c: dict[str, np.ndarray], most: int) -> Iterator[dict]:
    """Of rows (word, id, parity, more, size, at) sorted by word and size: the pairs that pass all filters (a, b), and the
    members of groups with more than ``most`` early rows. The numpy form of ``_passes``."""
    start = np.flatnonzero(np.concatenate([[True], c["word"][1:] != c["word"][:-1]]))
    count = np.diff(np.append(start, len(c["word"])))
    group = np.repeat(np.arange(len(start)), count)
    size, at = c["size"].astype(np.int64), c["at"].astype(np.int64)
    early = _early(at, size)
    large = (np.add.reduceat(early.astype(np.int64), start) > most)[group]
    if large.any():
        yield {k: c[k][large] for k in ("word", *MEMBER)}
    # The smaller of two sets is the one in front; it is early.
    i = np.flatnonzero(early & ~large)
    order = group.astype(np.int64) << 32 | size
    many = np.searchsorted(order, group[i].astype(np.int64) << 32 | size[i] * 5 // 4, side="right") - i - 1
    i, many = i[many > 0], many[many > 0]
    ends = np.cumsum(many)
    begin = 0
    while begin < len(i):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        x = np.repeat(i[begin:end], many[begin:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[begin:end] - many[begin:end] - done, many[begin:end])
        both = size[x] + size[y]
        least = (both * 4 + 8) // 9
        ok = np.minimum(size[x] - at[x], size[y] - at[y]) >= least - np.minimum(at[x], at[y])
        x, y, both = x[ok], y[ok], both[ok]
        apart = sum(np.bitwise_count(c[half][x] ^ c[half][y]).astype(np.int64) for half in ("parity", "more"))
        ok = (apart * 9 <= both) & (c["id"][x] != c["id"][y])
        a, b = c["id"][x[ok]].view(np.int64), c["id"][y[ok]].view(np.int64)
        yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}
        begin = end


def _ranks(c: dict[str, np.ndarray]) -> np.ndarray:
    """The order of each row's place; rows of one place share it."""
    doc, tie, line = (c[k] for k in PLACE)
    if doc.min() >= 0 and doc.max() < 1 << 38 and line.max() < 1 << 25 and not tie.any():
        keys = [doc << 25 | line]
        order = np.argsort(keys[0])
    else:
        keys = [line, tie, doc]
        order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _with_hubs(c: dict[str, np.ndarray], rank: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of large groups (``rows``, sorted by word), and those of the HUBS earliest of their groups that pass the
    filters with them. The numpy form of ``_passes``."""
    rows = rows[np.lexsort((rank[rows], c["word"][rows]))]
    word = c["word"][rows]
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.append(start, len(rows)))
    first = np.repeat(start, count)
    size, at = c["size"].astype(np.int64), c["at"].astype(np.int64)
    for i in range(HUBS):
        y, x = rows[np.minimum(first + i, len(rows) - 1)], rows
        ok = (np.repeat(count, count) > i) & (rank[y] < rank[x])
        x, y = x[ok], y[ok]
        both = size[x] + size[y]
        ok = np.minimum(size[x], size[y]) * 5 >= np.maximum(size[x], size[y]) * 4
        ok &= np.minimum(size[x] - at[x], size[y] - at[y]) >= (both * 4 + 8) // 9 - np.minimum(at[x], at[y])
        ok &= sum(np.bitwise_count(c[half][x] ^ c[half][y]).astype(np.int64) for half in ("parity", "more")) * 9 <= both
        yield x[ok], y[ok]


def _nearest_met(c: dict[str, np.ndarray], most: int, nearest: int) -> dict[str, np.ndarray]:
    """Of rows (word, doc, tie, line, parity, more, size, at) sorted by word and size: the columns of FOUND, up to ``nearest``
    rows for each set that may resemble an earlier one, and one at least if it is in a group with more than ``most`` early
    rows."""
    rank = _ranks(c)
    n = int(rank.max()) + 1
    held = np.zeros(n, np.int64)
    held[rank] = np.arange(len(rank))  # a row of each place
    crowded, others = np.zeros(n, bool), np.zeros(n, bool)
    # Pairs as one number each, in order of the later set, how far they are apart, and the earlier set.
    best, new, waiting = np.empty(0, np.int64), [], 0

    def take(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal waiting
        early, late = np.minimum(rank[x], rank[y]), np.maximum(rank[x], rank[y])
        apart = sum(np.bitwise_count(c[half][x] ^ c[half][y]).astype(np.int64) for half in ("parity", "more"))
        far = apart * FAR // (c["size"][x].astype(np.int64) + c["size"][y])
        new.append(((late * (FAR + 1) + far) * n + early)[early < late])
        waiting += len(new[-1])
        if waiting > PAIRS:
            keep()

    def keep() -> None:
        nonlocal best, new, waiting
        best = np.unique(np.concatenate([best, *new]))
        late = best // ((FAR + 1) * n)
        far_down = np.arange(len(best)) - np.searchsorted(late, late) >= nearest
        others[late[far_down]] = True
        best, new, waiting = best[~far_down], [], 0

    for found in _compared(c | {"id": np.arange(len(rank))}, most):
        if "a" in found:
            take(found["a"], found["b"])
        else:
            crowded[rank[found["id"]]] = True
            for x, y in _with_hubs(c, rank, found["id"]):
                take(x, y)
    keep()
    late, rest = np.divmod(best, (FAR + 1) * n)
    far, early = np.divmod(rest, n)
    alone = np.setdiff1d(np.flatnonzero(crowded), late)
    met, none = np.concatenate([late, alone]), np.zeros(len(alone), np.int64)
    known, earlier = np.arange(len(met)) < len(late), held[np.concatenate([early, none])]
    out = {k: c[k][held[met]] for k in PLACE} | {"far": np.concatenate([far, none]).astype(np.int32)}
    out |= {f"a_{k}": np.ma.array(c[k][earlier], mask=~known) for k in PLACE}
    return out | {"others": (crowded | others)[met]}


def _met(spread: DataFrame) -> DataFrame:
    """FOUND: of the rows (word, doc, tie, line, parity, more, size, at), the sets that may resemble an earlier one.

    A task reads its words one after the other, in sorted order, and holds ROWS rows and one word's at most. Words and
    sizes travel as one number, by which rows are sorted, and so do lines and places.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def batch_of(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows, most, nearest = 0, GROUP, NEAREST

        def joined() -> dict[str, np.ndarray]:
            return {k: np.concatenate([x[k] for x in held]) for k in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            part = {k: batch.column(k).to_numpy() for k in ("doc", "tie", "parity", "more")}
            for high, low, both in (("word", "size", 4), ("line", "at", 5)):
                both = batch.column(both).to_numpy()
                part |= {high: (both >> 32).astype(np.int32), low: both.astype(np.int32)}
            for half in ("parity", "more"):
                part[half] = part[half].view(np.uint64)
            held.append(part)
            rows += batch.num_rows
            if rows >= ROWS:
                c = joined()
                cut = int(np.searchsorted(c["word"], c["word"][-1]))
                if cut:
                    yield batch_of(_nearest_met({k: v[:cut] for k, v in c.items()}, most, nearest))
                held, rows = [{k: v[cut:] for k, v in c.items()}], len(c["word"]) - cut
        if rows:
            yield batch_of(_nearest_met(joined(), most, nearest))

    packed = [F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long")).alias(a) for a, b in (("word", "size"), ("line", "at"))]
    sent = spread.select("doc", "tie", "parity", "more", *packed)
    return sent.repartition(F.shiftright("word", 32)).sortWithinPartitions("word").mapInArrow(work, FOUND)


def _marked(rows: DataFrame, set_: DataFrame, columns: list[str] = PLACE) -> DataFrame:
    """The rows with ``columns`` of a row of ``set_``, and few others, as long as the bitmap has room. It has BITS_EACH bits
    for each row of ``set_`` (a staged frame, which is counted by its footers), and LINE_BITS at most."""
    bits = min(LINE_BITS, max(1 << 15, 1 << (BITS_EACH * set_.count()).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    number, bit = (F.call_function(f, place) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    maps = set_.select(number.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = rows.withColumns({"bucket": number, "bit": bit}).join(F.broadcast(maps), "bucket")
    return marked.filter(F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1).drop("bucket", "bit", "bits")


def _class() -> Column:
    return F.pmod("word", F.lit(CLASSES))


def _ends(pairs: DataFrame) -> DataFrame:
    """The places of the sets that are in a pair, each once."""
    return staged(pairs.select(*PLACE).union(pairs.select(*[f"a_{k}" for k in PLACE])).distinct(), "ends")


def _verified(pairs: DataFrame, rows: DataFrame, places: DataFrame) -> DataFrame:
    """The sets (doc, tie, line) of the pairs (doc, tie, line, a_doc, a_tie, a_line) that have the similarity. Only the
    lines at ``places``, those in a pair (and few others), leave their texts."""
    cut = _marked(rows, places, ["doc", "tie"]).select("doc", "tie", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    cut = _marked(cut, places).join(places, PLACE).select(*PLACE, "value")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        place = {k: batch.column(k).to_numpy() for k in PLACE}
        for begin, lines in slices(batch.column(3)):
            w = Words([x.lower() for x in lines], 1)
            words = [np.unique(x).view(np.int64) for x in np.split(w.hash[0], np.cumsum(w.count)[:-1])]
            yield {k: v[begin : begin + len(lines)] for k, v in place.items()} | {"words": words}

    words = staged(by_batch(cut, work, "doc long, tie long, line int, words array<bigint>"), "words")
    both = pairs.join(words.withColumnRenamed("words", "x"), PLACE)
    both = both.join(words.select(*[F.col(k).alias(f"a_{k}") for k in PLACE], F.col("words").alias("y")), [f"a_{k}" for k in PLACE])
    common = F.size(F.array_intersect("x", "y"))
    similar = staged(both.filter(common * 5 >= (F.size("x") + F.size("y") - common) * 4).select(*PLACE).distinct(), "similar")
    discard(words)
    return similar


def _spread(lines: DataFrame, *other: str) -> DataFrame:
    """(word, doc, tie, line, parity, more, size, at, hot) and other columns: the prefix words of lines with keys."""
    out = lines.select(*PLACE, *other, "parity", "more", "size", "lead", "cold", F.posexplode("keys").alias("at", "word"))
    return out.select("word", *PLACE, *other, *MEMBER[1:-1], (F.col("lead") + F.col("at")).alias("at"), (F.col("at") >= F.col("cold")).alias("hot"))


def _of(member: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{member}.{k}").alias(prefix + k) for k in PLACE]


def _met_hot(hot: DataFrame) -> DataFrame:
    """FOUND for the rows of hot words, which no task brings together: each set with the earliest ones of the word."""
    place = F.struct(*PLACE)
    hot = hot.select("word", place.alias("place"), F.struct(*PLACE, *MEMBER[1:]).alias("x"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("place"))
    hubs = hot.withColumn("rank", rank).filter(F.col("rank") <= HUBS).select("word", F.col("x").alias("y"), F.col("place").alias("before"))
    far = F.floor(_apart("x", "y") * FAR / (F.col("x.size") + F.col("y.size"))).cast("int").alias("far")
    met = hot.join(hubs, "word").filter((F.col("before") < F.col("place")) & _passes("x", "y")).select(*_of("x"), far, *_of("y", "a_"), F.lit(True).alias("others"))
    return met.union(hot.select(*_of("x"), F.lit(0), *[F.lit(None).alias(f"a_{k}") for k in PLACE], F.lit(True)))


def _nearest_of(found: DataFrame) -> DataFrame:
    """(doc, tie, line, near, others): the sets of FOUND, each once with all earlier sets that are named, closest first."""
    a = F.when(F.col("a_doc").isNotNull(), F.struct("far", *[F.col(f"a_{k}").alias(k) for k in PLACE]))
    return found.groupBy(*PLACE).agg(F.array_sort(F.collect_set(a)).alias("near"), F.bool_or("others").alias("others"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc, tie, gone): the numbers of each text's lines that go."""
    rare = rows.sparkSession.sparkContext.broadcast(rarity(rows))
    lines = staged(_lines(rows, rare), "lines")
    place = F.struct(*PLACE)
    earliest = staged(lines.groupBy("id", "check").agg(F.min(place).alias("place")).select("id", "check", "place.*"), "earliest")

    # Of the lines with one set only the earliest brings its words (and few others).
    worded = lines.filter(F.size("keys") > 0)
    keyed_lines = _marked(worded, earliest)
    # Of the words that are hot in the corpus, those that few sets have in their prefixes are compared as others are.
    hot = staged(_spread(keyed_lines.filter(F.size("keys") > F.col("cold"))).filter("hot").drop("hot"), "hot")
    early = F.count_if(_early(F.col("at"), F.col("size")))
    seen = hot.groupBy("word").agg(F.count("*").alias("all"), early.alias("n")).filter("all > 1 and n > 0")
    few = (F.col("all") <= HOT) & (F.col("n") <= GROUP)
    cold = _spread(keyed_lines).filter("not hot").drop("hot")
    met = _met(cold.union(hot.join(seen.filter(few).select("word"), "word").select(cold.columns)))
    found = staged(_nearest_of(met.union(_met_hot(hot.join(seen.filter(~few).select("word"), "word")))), "found")
    tried = found.filter(F.size("near") > 0).select(*PLACE, *[F.col("near")[0][k].alias(f"a_{k}") for k in PLACE])
    settled = _verified(tried, rows, _ends(tried))

    # Sets that the closest one does not settle meet the others that are known, or all with one of their prefix words.
    unsettled = staged(found.filter("others or size(near) > 1").join(settled, PLACE, "left_anti"), "unsettled")
    known = unsettled.filter("not others").select(*PLACE, F.explode(F.slice("near", 2, F.size("near"))).alias("y")).select(*PLACE, *_of("y", "a_"))
    wide = staged(unsettled.filter("others").select(*PLACE), "wide")
    mine = _marked(worded, wide).join(wide, PLACE, "left_semi")
    bits = ["third", "fourth"]
    mine = staged(_spread(mine, *bits).select("word", F.struct(*PLACE, *MEMBER[1:], *bits).alias("x")), "mine")
    near = F.broadcast(mine.select(_class().alias("class")).distinct())
    theirs = _spread(keyed_lines, *bits).withColumn("class", _class()).join(near, "class", "left_semi")
    theirs = theirs.select("word", F.struct(*PLACE, *MEMBER[1:], *bits).alias("y"))
    before = F.struct(*_of("y")) < F.struct(*_of("x"))
    met = mine.join(theirs, "word").filter(before & _passes_all("x", "y")).select(*_of("x"), *_of("y", "a_"))
    rest = staged(known.union(met).distinct(), "rest")
    late = staged(settled.union(_verified(rest, rows, _ends(rest))).distinct(), "late")

    # All lines of a late set go, and of the others all but the earliest.
    goes = _marked(earliest, late).join(late, PLACE).select("id", "check", F.lit(True).alias("goes"))
    sets = earliest.select("id", "check", place.alias("stays")).join(goes, ["id", "check"], "left")
    gone = lines.select("id", "check", *PLACE).join(sets, ["id", "check"]).filter(F.col("goes") | (place != F.col("stays")))
    return gone.groupBy("doc", "tie").agg(F.collect_set("line").alias("gone"))


def _without(rows: DataFrame) -> DataFrame:
    """The rows (text, gone, ...), the texts without the lines of the numbers ``gone``, null if none go."""
    cut = rows.withColumn("held", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("held") - 1), "gone")
    text = F.array_join(F.transform(stay, lambda i: F.col("held")[i]), "\n")
    return cut.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(text)).drop("held")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; ``n_chars``, if there, is counted anew where lines went.

    Lines are the parts between line feeds; those without a word stay. Lines are judged on the input, not on what is left. A document that loses lines and has no word left goes. Rows without an id come before
    all others; rows that share an id (or have none) are ordered by a hash of their texts, and equal ones among them
    count as one document. A null text has no lines and stays null. An empty table gives no rows.
    """
    rows = keyed(docs, F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    out = rows.join(repeated_lines(rows.select("doc", "tie", "text")), ["doc", "tie"], "left")
    out = _without(out.select("rest", "gone", "text")).filter(F.col("gone").isNull() | F.col("text").rlike(WORD))
    columns = [F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    for i, (name, kind) in enumerate(docs.dtypes):
        if name == "n_chars":
            columns[i] = F.when(F.col("gone").isNull(), F.col("rest.n_chars")).otherwise(F.char_length("text").cast(kind)).alias(name)
    return out.select(*columns)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (the numbers of the lines that go, from 0) of each row; see ``dedup_lines``."""
    rows = keyed(docs)
    counted = rows.select("doc", "tie", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = counted.join(repeated_lines(rows), ["doc", "tie"], "left")
    removed = F.array_sort(F.coalesce("gone", F.array().cast("array<int>")))
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
