"""Token ids in a word-aligned binary format (Simple-8b).

A segment holds the ids of whole documents, cut into blocks of ``BLOCK`` ids. Each 64-bit word has a 4-bit selector
and up to 60 ids of equal width; an id of more than 60 bits follows an escape word as it is. Words never cross
blocks and each block's first word is listed, so blocks are coded and decoded side by side.

Layout, little-endian: magic ``TS8B``, version (u32), documents (u64), ids (u64), blocks (u64), ids per document
(u64 each), first word of each block (u64 each), words (u64 each).

Segments are rows of Parquet files, which Spark commits as a whole: a lost executor leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, staged

MAGIC, VERSION, BLOCK = b"TS8B", 1, 256
#: Ids per word and bits per id of the selectors 1 to 14; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
SEGMENT_IDS = 1 << 18
#: Words whose ids a worker remembers before it starts anew (about 200 bytes each).
REMEMBERED = 1_400_000
#: Bytes of text that are cut into words at a time; a longer text is a slice of its own.
SLICE = 1 << 22


def _selectors(width: np.ndarray) -> np.ndarray:
    """For each place of a block (a row), the selector that packs most ids from there on."""
    best = np.zeros(width.shape, np.int8)
    blocks, places = width.shape
    top = int(width.max(initial=0))
    for s in range(14, 0, -1):
        if s > 1 and top <= WIDTHS[s - 1]:
            continue  # the next selector packs more ids at every place
        # Whether all of the n ids from a place on fit, by doubling; places behind a block's end fit always.
        n, fits, have = int(COUNTS[s]), np.ones((blocks, places + 60), bool), 1
        np.less_equal(width, WIDTHS[s], out=fits[:, :places])
        while have < n:
            step = min(have, n - have)
            fits = fits[:, :-step] & fits[:, step:]
            have += step
        np.copyto(best, np.int8(s), where=fits[:, :places])
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the first word of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK + 60, np.uint64)
    grid[: len(ids)] = ids
    width = np.searchsorted(POWERS, grid[: blocks * BLOCK], side="right").astype(np.int8).reshape(blocks, BLOCK)
    best = _selectors(width)
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = len(ids) - (blocks - 1) * BLOCK
    # All blocks advance by a word at a time.
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        s = best[live, at[live]]
        steps.append((live, at[live], s))
        at[live] += COUNTS[s]
        live = live[at[live] < length[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    block = np.concatenate([x[0] for x in steps])
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = np.concatenate([x[1] for x in steps])[order] + block * BLOCK
    sel = np.concatenate([x[2] for x in steps])[order]
    ends = np.cumsum(1 + (sel == 0))
    words = np.zeros(int(ends[-1]), np.uint64)
    place = ends - 1 - (sel == 0)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[place[rows] + 1] = grid[start[rows]]
            continue
        n, b = int(COUNTS[s]), int(WIDTHS[s])
        # Places behind a block's end belong to the next block; they are cut off as the words are read.
        inside = start[rows, None] + np.arange(n) < (block[rows, None] + 1) * BLOCK
        values = np.where(inside, grid[start[rows, None] + np.arange(n)], np.uint64(0))
        words[place[rows]] = np.uint64(s) << np.uint64(60) | np.bitwise_or.reduce(
            values << (np.arange(n, dtype=np.uint64) * np.uint64(b)), axis=1
        )
    first = np.zeros(blocks, np.uint64)
    first[block[::-1]] = place[::-1].astype(np.uint64)
    return words, first


def decode(words: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """The ids, from the words, the first word of each block and the number of ids."""
    out = np.zeros(len(first) * BLOCK + 60, np.uint64)
    if not count:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    # A word behind an escape holds a raw id. Escapes are rare: follow them one by one.
    raw = np.zeros(len(words), bool)
    starts = set(first.tolist()) if (sel == 0).any() else ()
    for i in np.flatnonzero(sel == 0):
        if i in starts or not raw[i]:
            raw[i + 1] = True
    sel[raw] = -1
    n = np.where(raw, 0, COUNTS[sel])
    block = np.searchsorted(first, np.arange(len(words), dtype=np.uint64), side="right") - 1
    before = np.cumsum(n) - n
    start = before - before[first.astype(np.int64)][block] + block * BLOCK
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[start[rows]] = words[rows + 1]
        elif s > 0:
            k, b = int(COUNTS[s]), int(WIDTHS[s])
            values = words[rows, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(b)) & np.uint64((1 << b) - 1)
            to = start[rows, None] + np.arange(k)
            inside = to < (block[rows, None] + 1) * BLOCK
            out[to[inside]] = values[inside]
    return out[:count]


def write_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    head = np.array([len(lengths), len(ids), len(first)], "<u8").tobytes()
    parts = [np.asarray(x, "<u8").tobytes() for x in (lengths, first, words)]
    return b"".join([MAGIC, VERSION.to_bytes(4, "little"), head, *parts])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids per document, and all ids."""
    if data[:4] != MAGIC or int.from_bytes(data[4:8], "little") != VERSION:
        raise ValueError("not a segment of this format")
    docs, count, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
    body = np.frombuffer(data, "<u8", -1, 32)
    return body[:docs], decode(body[docs + blocks :], body[docs : docs + blocks], count)


def _bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers, by the tokenizers library.

    The vocabulary's splitting pattern never joins text across white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: Iterable[bytes]) -> None:
        """Ids of new words. Words of letters, with marks behind them or not, are coded together: each part ends in a
        token that ends a word, so the ids can be told apart."""
        plain, parts = [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            stem = text.rstrip(".,;:!?%$*&#|")
            # The library lowers letter by letter; only a letter that stays one letter is safe here.
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                plain.append(word)
                parts.append(1 + (len(stem) < len(text)))
            else:
                self[word] = self.ids(text).tobytes()
        for k in range(0, len(plain), 500):
            some, count = plain[k : k + 500], np.cumsum(parts[k : k + 500])
            ids = self.ids(b" ".join(some).decode("utf-8", "replace"))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != count[-1]:  # a word that the library splits otherwise
                self.update((w, self.ids(w.decode("utf-8", "replace")).tobytes()) for w in some)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(some, (ends[count - 1] * 4).tolist()):
                self[word] = data[at:end]
                at = end

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null has none."""
        column = pc.fill_null(column, "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < len(column):
            size = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, size + SLICE, side="right")))
            yield from self._slice(column.slice(at, stop - at))
            at = stop

    def _slice(self, column: pa.Array) -> Iterator[np.ndarray]:
        # The library lowers letters as well, but looks for special tokens before.
        low = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        words = pc.ascii_split_whitespace(low)
        coded = words.flatten().dictionary_encode()
        ids = self._known(_bytes(coded.dictionary))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        pool = np.frombuffer(b"".join(ids), "<u4")
        index = coded.indices.to_numpy()
        count = length[index]
        before = np.concatenate([[0], np.cumsum(count)])
        out = pool[np.repeat(start[index] - before[:-1], count) + np.arange(before[-1])]
        cuts = before[words.offsets.to_numpy() - words.offsets[0].as_py()]
        yield from (out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def _known(self, words: list[bytes]) -> list[bytes]:
        if len(self) > REMEMBERED // 2:
            # Words that are still in use move over from the old half; the others are forgotten.
            self.old = dict(self)
            self.clear()
        found = list(map(self.get, words))
        if None in found:
            missing = {w for w, ids in zip(words, found) if ids is None}
            self.update((w, self.old[w]) for w in missing & self.old.keys())
            self.learn(missing - self.old.keys())
            found = list(map(self.get, words))
        return found


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One set of remembered words for each worker and vocabulary."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


SEGMENTS = "part int, at long, doc_ids array<bigint>, n_ids long, segment binary"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the ids of all documents (doc_id, text), each followed by ``end_id``, in ascending doc_id order; return the written segments.

    A segment is closed at the first document end behind ``segment_ids`` ids. ``part`` is the place of its range of
    ids, ``at`` the number of ids before it in that part. A null text has no ids of its own; null ids come first;
    rows of one id are ordered by a hash of their texts. An empty table gives no segments.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        count = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(p) + 1 for p in parts[::2]], np.int64)
            data = write_segment(lengths, np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([count], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "at", "doc_ids", "n_ids", "segment"],
            )

        known = words_of(vocabulary)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.column(batch.column(1))):
                doc_ids.append(doc_id)
                parts += [ids, end]
                count += len(ids) + 1
                if count >= segment_ids:
                    yield close()
                    doc_ids, parts, at, count = [], [], at + count, 0
        if parts:
            yield close()

    return staged(ordered.mapInArrow(run, SEGMENTS), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of each document, from written segments."""
    return _read(segments, "ids array<bigint>", lambda ids: {"ids": [x.tolist() for x in ids]})


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from written segments."""
    return _read(segments, "ids_crc32 long", lambda ids: {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})


def _read(segments: DataFrame, column: str, made) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, at, doc_ids, data in zip(*(batch.column(i) for i in range(4))):
            lengths, ids = read_segment(data.as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            yield {
                "doc_id": doc_ids.values,
                "part": np.full(len(lengths), part.as_py(), np.int32),
                "at": at.as_py() + ends - lengths.astype(np.int64),
                "n_tokens": lengths.astype(np.int64),
                **made(np.split(ids, ends[:-1])),
            }

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per written part: the bound of the broadcast is the number of parts.
    starts = staged(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "starts")
    rows = by_batch(segments.select("part", "at", "doc_ids", "segment"), work, f"doc_id long, part int, at long, n_tokens long, {column}")
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", column.split(" ")[0]
    )
